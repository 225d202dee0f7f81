import gzip

from spindrift.sources import formats
from spindrift.streaming import windows


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    rows = formats.fasta(spark, write(tmp_path / "a.fa", ">a first one\nACGT\nNN\n>b\n\n>c empty\n>d\r\nAC\r\nGT\r\n")).collect()
    assert sorted(map(tuple, rows)) == [("a", "first one", "ACGTNN"), ("b", "", ""), ("c", "empty", ""), ("d", "", "ACGT")]


def test_fastq_with_marks_in_qualities_and_compression(spark, tmp_path):
    text = "@r1 x\nACGT\n+\n@III\n@r2\nAC\n+r2\n>>\n"
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write(text)
    assert sorted(map(tuple, formats.fastq(spark, str(tmp_path / "a.fq.gz")).collect())) == [("r1", "x", "ACGT", "@III"), ("r2", "", "AC", ">>")]


def test_line_formats(spark, tmp_path):
    bed = formats.bed(spark, write(tmp_path / "a.bed", "#c\ntrack x\nchr1\t20\t10\tn\t5\t-\tx\ty\nchr2\t1\t2\nbad\tx\ty\n")).orderBy("chrom").collect()
    assert [(r.chrom, r.start, r.stop, r.name, r.score, r.strand, r.extra) for r in bed] == [("chr1", 10, 20, "n", 5.0, "-", ["x", "y"]), ("chr2", 1, 2, None, None, ".", [])]
    gff = formats.gff(spark, write(tmp_path / "a.gff", '##gff\nc\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Name=n\nc\ts\texon\t2\t3\t1.5\t-\t0\tgene_id "g1"; x "y";\n')).orderBy("start").collect()
    assert [r.attrs for r in gff] == [{"ID": "g1", "Name": "n"}, {"gene_id": "g1", "x": "y"}] and gff[0].score is None and gff[1].phase == "0"
    vcf = formats.vcf(spark, write(tmp_path / "a.vcf", "##x\n#CHROM\nc\t5\t.\tA\tG,T\t.\tPASS\tDP=3;DB\tGT:DP\t0/1:3\t./.\n")).first()
    assert (vcf.pos, vcf.id, vcf.qual, vcf.info, vcf.fmt, vcf.samples) == (5, None, None, {"DP": "3", "DB": ""}, ["GT", "DP"], ["0/1:3", "./."])
    sam = formats.sam(spark, write(tmp_path / "a.sam", "@HD\tVN:1\nq\t99\tc\t7\t60\t4M\t=\t9\t4\tACGT\tIIII\tNM:i:0\tRG:Z:a:b\n")).first()
    assert (sam.flag, sam.pos, sam.cigar, sam.tags) == (99, 7, "4M", {"NM": "0", "RG": "a:b"})


def test_typed_columns(spark, tmp_path):
    df = formats.typed(formats.delimited(spark, write(tmp_path / "a.tsv", "a\tb\n1\tx\n2\t3\nz\ty\n4\tq\n5\tq\n")))
    assert dict(df.dtypes) == {"a": "double", "b": "string"} and sorted(r.a or 0 for r in df.collect()) == [0, 1, 2, 4, 5]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = windows.windowed(stream, "ts", "value", "event_type", "1 day", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 4))
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, windows.windowed(batch, "ts", "value", "event_type", "1 day").collect()))
    assert windows.sessions(batch, "ts", "event_type", "1 hour").count() > 0
