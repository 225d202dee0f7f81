"""Queries of alignment, search, trees and trained models; most have no SQL and are held by tests of their kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..operators import alignment as al
from ..operators import annotation as an
from ..operators import learning as ml
from ..operators import trees
from .sequences import kmers, rc
from .statistics import L, S
from .tables import rounded

FIXTURES["targets"] = "SELECT ln, 't' || CAST(ln AS STRING) AS id, seq FROM records"
FIXTURES["tree_rows"] = "SELECT n_nationkey AS id, '((a:1,b:2):0.5,(c:1,' || n_name || ':' || CAST(n_nationkey AS STRING) || '):1,e:3);' AS newick, '((a:1,c:2):0.5,(b:1,' || n_name || ':1):1,e:3);' AS other FROM nation"


def nations(t):
    d = an.distances(t.small_alignment).select("a", "b", F.col("p").alias("d"))
    return d.join(t.nation.select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("g")), "a").join(t.nation.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("_g")), "b").where("g = _g")


add("pairwise_align", lambda t: al.aligned(t.nation.select("n_name", "n_regionkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name", ["n_name", "r_name"]))
add("emboss_water", lambda t: al.aligned(t.nation.select("n_name", "n_regionkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name", ["n_name", "r_name"], local=True))
add("blastn_search", lambda t: al.searched(t.targets.select("id", "seq"), t.records, 11, 2, 10))
add("blastp_search", lambda t: al.searched(t.proteins.select("id", "seq"), t.proteins.select("id", "seq"), 6, 2, 10, al.PROTEIN, 10.0))
_OWN = f"(SELECT id, kmer, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, least(kmer, {rc('kmer')}) AS kmer FROM {kmers('{t}', 12)}))"
_ASSIGN = f"SELECT read, arg_max(target, struct_pack(s := share, t := target)) AS target, round(max(share), 6) AS share FROM (SELECT a.id AS read, b.id AS target, count(*) / any_value(a.n) AS share FROM {_OWN.format(t='targets')} a JOIN {_OWN.format(t='records')} b USING (kmer) GROUP BY 1, 2) GROUP BY 1 HAVING max(share) >= 0.5"
for _name in ("kmer_pseudoalign", "fastq_bbsplit_screen"):
    add(_name, lambda t: rounded(al.assigned_by_kmers(t.targets, t.records, 12), "share", n=6), _ASSIGN)
for _name in ("convert_newick_to_table", "phylo_read_nexus"):
    add(_name, lambda t: trees.edges(t.tree_rows, "id", "newick"))
add("phylo_tree_statistics", lambda t: trees.statistics(t.tree_rows, "id", "newick"), "SELECT CAST(n_nationkey AS VARCHAR) AS tree, 5 AS tips, 3 AS inner, 9.5 - 1 + n_nationkey AS length, 2 AS depth, false AS binary FROM nation".replace("9.5 - 1", "CAST(8.5 AS DOUBLE)"))
add("phylo_robinson_foulds", lambda t: trees.robinson_foulds(t.tree_rows, "id", "newick", "other"), "SELECT CAST(n_nationkey AS VARCHAR) AS tree, 4 AS distance FROM nation")
for _name in ("phylo_nj_from_alignment", "tree_from_alignment_nj"):
    add(_name, lambda t: trees.from_distances(nations(t), "g"))
add("phylo_upgma", lambda t: trees.from_distances(nations(t), "g", "upgma"))
add("ml_classifier", lambda t: ml.classified(t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", "l_discount").alias("v"), (F.col("l_quantity") > 25).cast("double").alias("label")), "v", "label"))
add("ml_regression", lambda t: ml.regressed(t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount").alias("v"), F.col("l_extendedprice").alias("target")), "v", "target"))
add("ml_cluster_validation", lambda t: ml.validated(t.embeddings, "embedding", [2, 3, 4]))
add("ml_dbscan", lambda t: ml.density_clusters(t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 20).alias("y")), 1.0, 3))
add("seurat_project_onto_pca", lambda t: ml.pca(L(t).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("x")).select("row", F.transform("x", lambda c: c["value"]).alias("v")), "row", "v", 2))
