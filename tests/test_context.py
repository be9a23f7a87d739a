import pytest
from pyspark.sql import functions as F

from lumenloom.operators import context


def of(**fields):
    return tuple(fields.get(k) for k in ("species", "tissue", "disease", "cell_type", "perturbation", "condition", "comparator", "timepoint"))


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        (1, "g", of(species=["Human"], tissue=["blood"]), "cd4 t cell", True), (2, "g", of(species=["human"], tissue=["blood"]), "t cell", True), (3, "g", of(species=["mouse"], tissue=["blood"]), "t cell", True),
        (4, "g", of(species=["human"], tissue=["blood"], disease=["RA"]), "b cell", True), (5, "g", of(), "odd cell", False), (6, "h", of(species=["human"]), "t cell", True),
    ]
    return spark.createDataFrame(rows, f"edge_id int, dst string, context {context.CONTEXT}, cell string, cell_known boolean")


def test_contexts_compose_or_block(spark, edges):
    closure = spark.createDataFrame([("cd4 t cell", "t cell"), ("t cell", "lymphocyte"), ("cd4 t cell", "lymphocyte")], "node string, ancestor string")
    got = {(r.a, r.b): r.score for r in context.compatible_pairs(edges, closure).collect()}
    # parent and child pass at 0.6; another species, a known stranger and another target do not; gaps cost
    assert got[1, 2] == 0.6 and (1, 3) not in got and (2, 4) not in got and not any(6 in k for k in got)
    assert got[1, 5] == round(0.8 * 0.8 * 0.95, 3) and got[4, 5] == round(0.8 * 0.8 * 0.9 * 0.95, 3)


def test_species_and_aliases(spark):
    df = spark.createDataFrame([("Homo sapiens and mice",), ("Murine",), ("Mus ",), ("rat",), (None,)], "s string")
    assert [r.x for r in df.select(context.species(F.col("s")).alias("x")).collect()] == ["human", "mouse", "mouse", "", ""]
    aliases = spark.createDataFrame([("T-cells", "T cell"), ("IFN-γ", "interferon gamma")], "alias string, canonical string")
    rows = spark.createDataFrame([("t-cells ",), ("ifn-γ",), ("TNF-α",)], "name string")
    assert [(r.c, r.c_known) for r in context.canonical(rows, "name", aliases, "c").collect()] == [("T cell", True), ("interferon gamma", True), ("TNF-alpha", False)]


def test_scores(spark, edges):
    one = edges.where("edge_id = 4")
    r = one.select(
        context.context_match(F.col("context"), F.lit(False)).alias("m"), context.context_match(F.col("context"), F.lit(True)).alias("p"), context.specificity(F.col("context"), F.lit(True), F.lit(False)).alias("s"),
        context.risk_penalty({"bridge": F.lit(True), "no_tissue": F.lit(True), "single_paper": F.lit(False)}).alias("r"),
        context.evidence_design(F.array(F.lit("case_control"), F.lit("descriptive_marker"))).alias("d"), context.evidence_design(F.array(F.lit("descriptive_marker"))).alias("e"),
        context.rank_score({k: F.lit(1.0) for k in context.WEIGHTS}, F.lit(0.3)).alias("k"), context.rank_score({k: F.lit(0.1) for k in context.WEIGHTS}, F.lit(0.3)).alias("z"),
    ).first()
    assert (r.m, r.p, r.s, round(r.r, 6), r.d, r.e, r.k, r.z) == (0.6, 0.6, 0.5, 0.3, 0.65, 0.25, 0.7, 0.0)
