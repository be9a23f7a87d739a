"""Findings of evidence records as typed, signed frames, and the evidence graph that they make.

Everything is a Column expression over one row a finding: entities are structs, alias tables are map literals. A record's
own lists are the vocabulary; a finding that is not clear gives no frame but a reason.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text
from lumenloom.operators import context
from lumenloom.runtime import materialize

# Aliases of diseases, perturbations and cell types (with lineage parents), markers and their genes.
DISEASES = {
    "covid-19": "COVID-19", "covid 19": "COVID-19", "covid19": "COVID-19", "covid": "COVID-19", "sars-cov-2 infection": "COVID-19", "sars-cov-2": "COVID-19", "sars cov 2": "COVID-19",
    "type 1 diabetes": "type 1 diabetes", "t1d": "type 1 diabetes", "systemic lupus erythematosus": "systemic lupus erythematosus", "sle": "systemic lupus erythematosus",
    "rheumatoid arthritis": "rheumatoid arthritis", "ra": "rheumatoid arthritis",
}
PERTURBATIONS = {
    "anti-cd3/cd28": "anti-CD3/CD28", "cd3/cd28 stimulation": "anti-CD3/CD28", "anti-cd3/anti-cd28": "anti-CD3/CD28", "cd3/cd28": "anti-CD3/CD28", "anti-cd3 anti-cd28": "anti-CD3/CD28",
    "ifn-beta": "IFN-beta", "ifn beta": "IFN-beta", "interferon beta": "IFN-beta", "interferon-beta": "IFN-beta", "ifnb": "IFN-beta", "ifn-b": "IFN-beta", "ifnbeta": "IFN-beta",
    "ifn-gamma": "IFN-gamma", "interferon gamma": "IFN-gamma", "ifng": "IFN-gamma", "ifn-alpha": "IFN-alpha", "interferon alpha": "IFN-alpha", "lps": "LPS", "lipopolysaccharide": "LPS",
    "anti-pd-1": "anti-PD-1", "anti pd 1": "anti-PD-1", "anti-pd1": "anti-PD-1", "pembrolizumab": "anti-PD-1", "il-2": "IL-2", "il2": "IL-2", "tgf-beta": "TGF-beta", "tgf beta": "TGF-beta",
}
CELLS = {
    "T cell": ("lymphocyte", ("T cells", "T lymphocyte", "T lymphocytes", "T-cell")),
    "CD4-positive T cell": ("T cell", ("CD4 T", "CD4+ T cell", "CD4 T cell", "CD4+ T cells", "CD4 T cells", "helper T cell", "CD4 cell")),
    "CD8-positive T cell": ("T cell", ("CD8 T", "CD8+ T cell", "CD8 T cell", "CD8+ T cells", "CD8 T cells", "cytotoxic T cell", "CTL", "CD8 cell")),
    "regulatory T cell": ("CD4-positive T cell", ("Treg", "Tregs", "FOXP3+ Treg", "FOXP3 Treg", "CD4 regulatory T cell", "regulatory T cells", "Treg cell")),
    "T helper 17 cell": ("CD4-positive T cell", ("Th17", "Th17 cell", "Th17 cells", "T helper 17")),
    "T helper 1 cell": ("CD4-positive T cell", ("Th1", "Th1 cell", "Th1 cells", "T helper 1")),
    "memory T cell": ("T cell", ("memory T cells", "T memory cell")),
    "B cell": ("lymphocyte", ("B cells", "B lymphocyte", "B lymphocytes", "B-cell")),
    "plasma cell": ("B cell", ("plasma cells", "antibody-secreting cell", "plasmablast", "plasmablasts")),
    "NK cell": ("lymphocyte", ("natural killer cell", "natural killer cells", "NK cells", "CD56 NK", "NK")),
    "monocyte": ("myeloid cell", ("monocytes", "classical monocyte", "non-classical monocyte", "CD14 monocyte", "CD14+ monocyte")),
    "macrophage": ("myeloid cell", ("macrophages", "mononuclear phagocyte")),
    "dendritic cell": ("myeloid cell", ("dendritic cells", "DC", "DCs", "conventional dendritic cell", "plasmacytoid dendritic cell", "pDC", "cDC")),
    "neutrophil": ("myeloid cell", ("neutrophils", "polymorphonuclear leukocyte", "PMN")),
    "myeloid cell": ("leukocyte", ("myeloid cells", "myeloid")),
    "lymphocyte": ("leukocyte", ("lymphocytes",)),
    "leukocyte": (None, ("leukocytes", "white blood cell", "immune cell", "immune cells", "PBMC", "PBMCs")),
}
MARKERS = {
    "CD25": "IL2RA", "CD279": "PDCD1", "PD-1": "PDCD1", "PD-L1": "CD274", "CD20": "MS4A1", "CD127": "IL7R", "CD16": "FCGR3A", "CD56": "NCAM1", "CD8": "CD8A", "CD3": "CD3E", "CD62L": "SELL", "CCR7": "CCR7",
    "CTLA4": "CTLA4", "CD152": "CTLA4", "CD138": "SDC1", "CD117": "KIT", "CD123": "IL3RA", "CD11b": "ITGAM", "CD11c": "ITGAX", "CD14": "CD14", "CD45RA": "PTPRC", "CD45RO": "PTPRC",
}
# The words of findings.
INCREASE = (
    "increase", "increased", "increases", "increasing", "elevated", "higher", "upregulated", "up-regulated", "upregulation", "induced", "induces", "expanded", "enriched", "enhanced", "augmented", "greater", "more abundant",
)
DECREASE = (
    "decrease", "decreased", "decreases", "decreasing", "reduced", "reduction", "lower", "downregulated", "down-regulated", "downregulation", "depleted", "contracted", "suppressed", "diminished", "loss of", "fewer", "less abundant",
)
ASSOCIATION = ("associated with", "correlated with", "correlation", "linked to", "predictive of", "related to", "associated")
AGAINST = ("inversely", "negatively", "anti-correlated", "negative correlation")
NO_CHANGE = ("no change", "unchanged", "not significantly different", "did not alter", "no significant effect", "no difference", "not altered")
MARKS = ("marks", "marked by", "marked", "marker of", "markers of", "expressed by", "characterized by", "defined by", "identifies", "identified by", "delineates")
EXPRESSES = ("express", "expressed", "expresses", "expression of", "expressing")
TIMEPOINT = ("day ", "days ", "week", "month", "baseline", "follow-up", "followup", "before", "after", "over time", "trajectory", "longitudinal", "timepoint", "time point", "kinetics", "dynamics over")
CASE_CONTROL = (
    "severe", "mild", "moderate", "critical", "patient", "patients", "healthy", "control", "controls", "responder", "non-responder", "nonresponder", "vaccinated", "unvaccinated", "versus", " vs ", "compared with", "compared to",
    "relative to", "case", "infected", "convalescent",
)
FREQUENCY = ("frequency", "frequencies", "proportion", "proportions", "abundance", "percentage", "percent", "fraction", "%", "numbers of", "counts of")
COMPARED = ("compared with", "compared to", "versus", " vs ", "relative to")
CONDITIONS = ("unstimulated", "stimulated", "activated", "resting", "severe", "mild", "infected")
NEGATIONS = (
    r"\b(?:did|does|do)\s+not\s+(?:\w+\s+){0,2}__TERM__\b", r"\bnot\s+(?:significantly\s+)?(?:\w+\s+){0,2}__TERM__\b", r"\bno\s+(?:significant\s+)?__TERM__\b",
    r"\bfailed\s+to\s+(?:\w+\s+){0,2}__TERM__\b", r"\bfails\s+to\s+(?:\w+\s+){0,2}__TERM__\b", r"\bwithout\s+(?:\w+\s+){0,2}__TERM__\b",
)
RELATIONS = {"increase": "INCREASES_READOUT", "decrease": "DECREASES_READOUT", "association_positive": "ASSOCIATED_WITH_HIGHER_READOUT", "association_negative": "ASSOCIATED_WITH_LOWER_READOUT"}
STEM_STOP = (
    "the", "and", "for", "with", "were", "was", "are", "this", "that", "from", "into", "which", "not", "have", "has", "had", "used", "using", "our", "your", "per", "paper", "reports", "report", "reported", "study", "shows", "showed",
    "show", "found", "observed", "compared", "relative", "than", "between", "within",
)

ENTITY = "struct<entity_id:string,type:string,name:string,species:string,confidence:double,parent:string,marker:string,gene:string,genes:array<string>>"
_EMPTY = "array<string>"


def _fold(x: str) -> str:
    return "".join(text.GREEK.get(c, c) for c in x)


def _key(x: str) -> str:
    return " ".join(_fold(x).split()).lower().strip(" .,:;()[]{}")


def _lineage(name: str) -> tuple[str, ...]:
    up = CELLS[name][0]
    return (up, *_lineage(up)) if up else ()


_CELL_OF = {_key(a): c for c, (_, names) in CELLS.items() for a in (c, *names)}
_SPELLINGS = {c: tuple(_key(a) for a in (c, *names)) for c, (_, names) in CELLS.items()}
_ABOVE = {c: _lineage(c) for c in CELLS if CELLS[c][0]}
_PARENT = {c: p for c, (p, _) in CELLS.items() if p}
_GENE_OF = {_key(m): g for m, g in MARKERS.items()}
_MARKER_OF = {_key(g): m for m, g in reversed(MARKERS.items())}  # the first marker of a gene


def alias_key(x: Column) -> Column:
    """Folded, squeezed, lower-cased; punctuation stays."""
    return F.lower(text.squeeze(text.fold_greek(F.coalesce(x, F.lit("")))))


def disease_name(x: Column) -> Column:
    return F.coalesce(F.try_element_at(text.constant_map(DISEASES), alias_key(x)), F.trim(text.fold_greek(x)))


def perturbation_name(x: Column) -> Column:
    return F.coalesce(F.try_element_at(text.constant_map(PERTURBATIONS), alias_key(x)), F.trim(text.fold_greek(x)))


def cell_name(x: Column) -> Column:
    """Canonical cell type; an unknown name as it is."""
    return F.coalesce(F.try_element_at(text.constant_map(_CELL_OF), text.normalize(x)), F.trim(F.coalesce(x, F.lit(""))))


def cell_known(x: Column) -> Column:
    return F.try_element_at(text.constant_map(_CELL_OF), text.normalize(x)).isNotNull()


def cell_spellings(canonical: Column) -> Column:
    return F.coalesce(F.try_element_at(text.constant_map(_SPELLINGS), canonical), F.array().cast(_EMPTY))


def cell_ancestors(canonical: Column) -> Column:
    return F.coalesce(F.try_element_at(text.constant_map(_ABOVE), canonical), F.array().cast(_EMPTY))


def marker_of(gene: Column) -> Column:
    """The surface marker that measures a gene; null if there is none."""
    return F.try_element_at(text.constant_map(_MARKER_OF), text.normalize(gene))


def gene_of(marker: Column) -> Column:
    return F.try_element_at(text.constant_map(_GENE_OF), text.normalize(marker))


def entity(kind: str, name: Column, species: Column | None = None, confidence: Column | float = 1.0, parent: Column | None = None, marker: Column | None = None, gene: Column | None = None, genes: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    known = none if species is None else text.empty_to_null(species)
    return F.struct(
        text.entity_id(F.lit(kind), F.coalesce(known, F.lit("")), name).alias("entity_id"), F.lit(kind).alias("type"), name.alias("name"), known.alias("species"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), (none if parent is None else parent).alias("parent"), (none if marker is None else marker).alias("marker"),
        (none if gene is None else gene).alias("gene"), (F.lit(None).cast(_EMPTY) if genes is None else genes).alias("genes"),
    )


def gene_entity(symbol: Column, species: Column) -> Column:
    """A gene's RNA; a mouse gene counts 0.7; the marker that measures it, if known."""
    sp = context.species(species)
    return entity("GENE_RNA", F.trim(symbol), sp, F.when(sp == "mouse", 0.7).otherwise(1.0), marker=marker_of(symbol))


def marker_entity(name: Column, maps_to: Column, species: Column) -> Column:
    """A surface protein; the gene it is said to map to, else the table's."""
    return entity("SURFACE_PROTEIN", F.trim(name), context.species(species), gene=F.coalesce(text.empty_to_null(F.trim(maps_to)), gene_of(name)))


def cell_entity(name: Column, species: Column) -> Column:
    canonical = cell_name(name)
    return entity("CELL_TYPE", canonical, context.species(species), F.when(cell_known(name), 1.0).otherwise(0.6), parent=F.try_element_at(text.constant_map(_PARENT), canonical))


def disease_entity(name: Column) -> Column:
    return entity("DISEASE", disease_name(name))


def perturbation_entity(name: Column) -> Column:
    return entity("PERTURBATION", perturbation_name(name))


def signature_entity(name: Column, genes: Column, species: Column) -> Column:
    return entity("SIGNATURE", F.trim(name), context.species(species), genes=F.coalesce(genes, F.array().cast(_EMPTY)))


def modality(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(text.constant_map({"GENE_RNA": "rna", "SURFACE_PROTEIN": "surface_protein", "SIGNATURE": "signature", "CELL_FREQUENCY": "cell_frequency"}), kind), F.lit("unknown"))


def has_any(folded: Column, terms: Sequence[str]) -> Column:
    """Whether any term stands in the folded text, inside longer words too."""
    found = F.lit(False)
    for t in terms:
        found = found | folded.contains(t)
    return found


def negated(folded: Column, terms: Sequence[str]) -> Column:
    """Whether an effect is denied: did not increase, failed to reduce."""
    import re

    either = "(?:" + "|".join(re.escape(t).replace("\\-", "-") for t in terms) + ")"
    found = F.lit(False)
    for pattern in NEGATIONS:
        found = found | folded.rlike(pattern.replace("__TERM__", either))
    return found


def _present(folded: Column, found: Column) -> Column:
    """Entities of which a form of two letters or more stands in the text as a word, with a plural s perhaps."""
    named = lambda f: (F.length(f) >= 2) & F.regexp_like(folded, F.concat(F.lit(r"(?<![a-z0-9])\Q"), f, F.lit(r"\Es?(?![a-z0-9])")))
    return F.transform(F.filter(found, lambda e: F.exists(e["forms"], named)), lambda e: e["entity"])


def vocabulary(records: DataFrame) -> DataFrame:
    """Records with __genes, __markers, __cells, __diseases, __perturbations, __signatures: arrays of struct(entity, forms)."""
    sp = F.array_join(F.coalesce("species", F.array().cast(_EMPTY)), " ")
    have = {f.name for f in records.schema.fields}

    def listed(field: str, name: str, made: Callable[[Column], Column], more: Callable[[Column], Column] | None = None) -> Column:
        if field not in have:
            return F.array().cast(f"array<struct<entity:{ENTITY},forms:array<string>>>")
        kept = F.filter(F.coalesce(field, F.array().cast(records.schema[field].dataType)), lambda x: F.coalesce(x[name], F.lit("")) != "")

        def forms(p: Column) -> Column:
            own = F.transform(F.array(p["raw"], p["entity"]["name"]), alias_key)
            return F.array_distinct(own if more is None else F.concat(own, more(p["entity"])))

        pairs = F.transform(kept, lambda x: F.struct(made(x).alias("entity"), x[name].alias("raw")))
        return F.transform(pairs, lambda p: F.struct(p["entity"].alias("entity"), forms(p).alias("forms")))

    member = lambda field, name: name in {m.name for m in records.schema[field].dataType.elementType.fields} if field in have else False
    gene_species = lambda x: F.coalesce(text.empty_to_null(x["species"]), sp) if member("genes", "species") else sp
    mapped = lambda x: F.coalesce(x["maps_to_gene"], F.lit("")) if member("surface_markers", "maps_to_gene") else F.lit("")
    return records.select(
        "*", listed("genes", "symbol", lambda x: gene_entity(x["symbol"], gene_species(x))).alias("__genes"), listed("surface_markers", "marker", lambda x: marker_entity(x["marker"], mapped(x), sp)).alias("__markers"),
        listed("cell_types", "name", lambda x: cell_entity(x["name"], sp), lambda e: cell_spellings(e["name"])).alias("__cells"), listed("diseases", "name", lambda x: disease_entity(x["name"])).alias("__diseases"),
        listed("perturbations", "name", lambda x: perturbation_entity(x["name"])).alias("__perturbations"), listed("signatures", "name", lambda x: signature_entity(x["name"], x["genes"], sp)).alias("__signatures"),
    )


def _first_cue(folded: Column) -> Column:
    """Up to four words after the first cue, in order of the cues, that has words after it."""
    found = []
    for cue in COMPARED:
        at = F.instr(folded, cue)
        tail = F.trim(F.substring(folded, at + len(cue), F.length(folded)))
        words = F.array_join(F.slice(F.split(tail, " "), 1, 4), " ")
        found.append(F.when((at > 0) & (tail != ""), F.regexp_replace(words, r"^[ .,;]+|[ .,;]+$", "")))
    return F.coalesce(*found)


def comparator(folded: Column) -> Column:
    return F.coalesce(_first_cue(folded), F.when(folded.contains("healthy control") | folded.contains("healthy donor"), "healthy control").when(folded.contains("unstimulated"), "unstimulated control"))


def condition(folded: Column) -> Column:
    return F.coalesce(*[F.when(folded.contains(c), c) for c in CONDITIONS])


def timepoint(statement: Column) -> Column:
    low = F.lower(statement)
    return F.coalesce(F.nullif(F.regexp_extract(statement, r"(?i)\b(day|week|month)\s*\d+\b", 0), F.lit("")), *[F.when(low.contains(t), t) for t in ("baseline", "follow-up", "convalescent")])


def atomic_claim(anchor: Column, readout: Column, mode: Column, direction: Column, cell: Column, against: Column, disease: Column) -> Column:
    """One sentence that says what the paper reports."""
    measure = F.when(readout["type"].isin("GENE_RNA", "SURFACE_PROTEIN"), "expression").when(readout["type"] == "SIGNATURE", "signature").otherwise("level")
    where = F.when(cell != "", F.concat(F.lit(" in "), cell)).otherwise("")
    name, say = readout["name"], lambda *x: F.concat(F.lit("The paper reports that "), *[F.lit(p) if isinstance(p, str) else p for p in x])
    verb = F.when(direction == "increase", "increased").when(direction == "decrease", "decreased").when(direction == "no_change", "did not change").otherwise("changed")
    level = F.when(direction == "association_positive", "higher").when(direction == "association_negative", "lower").when(direction == "no_change", "unchanged").otherwise("altered")
    compared = F.when(against.isNotNull(), F.concat(F.lit(" compared with "), against)).otherwise("")
    return (
        F.when(mode.isin("interventional", "longitudinal"), say(F.coalesce(anchor["name"], F.lit("the perturbation")), " ", verb, " ", name, " ", measure, where, "."))
        .when(mode == "case_control", say(F.coalesce(F.try_element_at(disease, F.lit(1)), F.lit("the disease condition")), " was associated with ", level, " ", name, " ", measure, where, compared, "."))
        .when(mode == "cross_sectional_association", say(F.when(direction == "association_positive", "higher").otherwise("lower"), " ", name, " ", measure, " was observed", where, "."))
        .when(mode == "descriptive_marker", say(name, " marks ", F.when(cell != "", cell).otherwise("the cell type"), "."))
        .when(mode == "descriptive_expression", say(F.when(cell != "", cell).otherwise("the cell type"), " expresses ", name, "."))
        .otherwise(F.concat(F.lit("The paper reports a finding about "), name, where, F.lit(".")))
    )


def read_findings(records: DataFrame, require_comparator: bool = False) -> DataFrame:
    """One row a finding of a record of some relevance: what it names, its mode and direction, and ``reason`` where it gives no frame.

    A finding without a statement is none; a record without findings gives no row.
    """
    rows = vocabulary(records.where(F.col("relevance").isin("HIGH", "MODERATE", "LOW")))
    rows = rows.select("paper_id", "relevance", F.coalesce("species", F.array().cast(_EMPTY)).alias("species"), F.coalesce("tissue", F.array().cast(_EMPTY)).alias("tissue"), *[c for c in rows.columns if c.startswith("__")], F.posexplode("findings").alias("idx", "f"))
    rows = rows.where(F.trim(F.coalesce("f.statement", F.lit(""))) != "").withColumn("statement", F.col("f.statement")).withColumn("quote", F.coalesce("f.source_quote", F.lit(""))).withColumn("folded", alias_key(F.col("f.statement")))
    t = F.col("folded")
    named = {n: _present(t, F.col(f"__{n}")) for n in ("genes", "markers", "signatures", "cells", "diseases", "perturbations")}
    seen = rows.select("paper_id", "relevance", "species", "tissue", "idx", "statement", "quote", "folded", *[c.alias(n) for n, c in named.items()], F.transform("__cells", lambda e: e["entity"]).alias("all_cells"))
    neg_inc, neg_dec = negated(t, INCREASE), negated(t, DECREASE)
    seen = seen.select(
        "*", (has_any(t, NO_CHANGE) | neg_inc | neg_dec).alias("flat"), (has_any(t, INCREASE) & ~neg_inc).alias("inc"), (has_any(t, DECREASE) & ~neg_dec).alias("dec"), has_any(t, ASSOCIATION).alias("assoc"),
        has_any(t, MARKS).alias("marks"), has_any(t, EXPRESSES).alias("expr"), has_any(t, AGAINST).alias("against"), (F.size("perturbations") > 0).alias("pert"), has_any(t, TIMEPOINT).alias("timed"),
        ((F.size("diseases") > 0) | has_any(t, CASE_CONTROL)).alias("cases"), has_any(t, FREQUENCY).alias("freq"), ((F.size("cells") == 0) & (F.size("all_cells") == 1)).alias("inferred"),
    )
    seen = seen.withColumn("cell", F.when(F.size("cells") > 0, F.col("cells")[0]).when(F.col("inferred"), F.col("all_cells")[0]))
    moved = F.col("inc") | F.col("dec")
    share = F.concat(F.col("cell.name"), F.lit(" frequency"))
    frequency = F.when(F.col("freq") & F.col("cell").isNotNull() & (moved | F.col("assoc")), F.array(entity("CELL_FREQUENCY", share, F.coalesce(F.col("cell.species"), F.lit("")), parent=F.col("cell.name"))))
    own = F.concat("genes", "markers", "signatures")
    seen = seen.withColumn("readouts", F.when(F.size(own) > 0, own).otherwise(F.coalesce(frequency, F.array().cast(f"array<{ENTITY}>"))))
    flat, inc, dec, assoc, pert, timed, cases, marks = (F.col(c) for c in ("flat", "inc", "dec", "assoc", "pert", "timed", "cases", "marks"))
    described = (marks | (F.col("expr") & ~moved)) & ~(moved | assoc)
    mode = (
        F.when(flat, F.when(pert, "interventional").when(cases, "case_control").otherwise("unknown")).when(described, F.when(marks, "descriptive_marker").otherwise("descriptive_expression"))
        .when(pert & moved, "interventional").when(timed & moved, "longitudinal").when(cases & (moved | assoc), "case_control").when(assoc, "cross_sectional_association")
    )
    seen = seen.withColumn("mode", mode)
    sided = F.when(F.col("against"), "association_negative").otherwise("association_positive")
    direction = (
        F.when(flat, "no_change").when(F.col("mode").isin("descriptive_marker", "descriptive_expression"), "unknown").when(F.col("mode").isin("interventional", "longitudinal"), F.when(inc, "increase").otherwise("decrease"))
        .when(F.col("mode") == "case_control", F.when(inc & ~dec, "association_positive").when(dec & ~inc, "association_negative").otherwise(sided)).otherwise(sided)
    )
    acted, controlled = F.col("mode").isin("interventional", "longitudinal") & pert, (F.col("mode") == "case_control") & (F.size("diseases") > 0)
    reason = (
        F.when(F.size("readouts") == 0, "missing_readout").when(~flat & described & F.col("cell").isNull(), "descriptive_without_cell_type").when(~flat & ~described & inc & dec, "ambiguous_mixed_direction")
        .when(F.col("mode").isNull(), "unparsed_direction").when((acted & (F.size("perturbations") > 1)) | (controlled & (F.size("diseases") > 1)), "ambiguous_multiple_anchors")
    )
    seen = seen.withColumn("direction", direction).withColumn("reason", reason).withColumn("anchor", F.when(acted, F.col("perturbations")[0]).when(controlled, F.col("diseases")[0]))
    compared = comparator(t)
    lacking = (F.col("mode") == "case_control") & compared.isNull()
    given = F.when((F.col("mode") == "interventional") & compared.isNull() & F.lit(require_comparator), "unstimulated control").otherwise(compared)
    mixed = inc & dec
    warnings = F.array_compact(F.array(F.when(F.col("inferred"), "cell_type_inferred"), F.when(lacking, "missing_comparator"), F.when(mixed, "mixed_direction_terms")))
    less = lambda c, by: F.when(c, by).otherwise(0.0)
    confidence = F.round(F.greatest(1.0 - less(F.col("inferred"), 0.15) - less(lacking, 0.1) - less(mixed, 0.15), F.lit(0.1)), 3)
    done = seen.withColumn("comparator", given).withColumn("warnings", warnings).withColumn("confidence", confidence)
    # written, so that no filter on what was read is pushed below the reading and repeats it
    return materialize(done.drop("folded_", "all_cells"), "findings")


def frames(findings: DataFrame) -> DataFrame:
    """One frame a readout of each clear finding."""
    rows = findings.where("reason IS NULL").select("*", F.posexplode("readouts").alias("k", "readout"))
    names = lambda c: F.array_distinct(F.transform(c, lambda e: e["name"]))
    nothing = F.array().cast(_EMPTY)
    cell = F.coalesce(F.col("cell.name"), F.lit(""))
    rows = rows.withColumn("disease", names("diseases"))
    made = F.struct(
        "species", "tissue", "disease", F.when(cell != "", F.array(cell)).otherwise(nothing).alias("cell_type"), F.when(F.col("mode").isin("interventional", "longitudinal"), names("perturbations")).otherwise(nothing).alias("perturbation"),
        condition(F.col("folded")).alias("condition"), F.col("comparator"), timepoint(F.col("statement")).alias("timepoint"),
    )
    return rows.select(
        F.concat("paper_id", F.lit("::f"), F.col("idx").cast("string"), F.lit("::"), text.slug(F.col("readout.name")), F.lit("::"), F.col("k").cast("string")).alias("frame_id"), "paper_id", "idx", "k", F.col("statement").alias("raw_statement"),
        F.col("quote").alias("source_quote"), "relevance", "readout", modality(F.col("readout.type")).alias("modality"), "direction", made.alias("context"), F.col("mode").alias("evidence_mode"), F.col("confidence").alias("parser_confidence"),
        atomic_claim(F.col("anchor"), F.col("readout"), F.col("mode"), F.col("direction"), cell, F.col("comparator"), F.col("disease")).alias("atomic_claim"), "anchor", "cell", "warnings",
    )


def skipped(findings: DataFrame) -> DataFrame:
    """Findings without a frame, and why."""
    return findings.where("reason IS NOT NULL").select("paper_id", F.col("statement").alias("finding_text"), "reason", F.col("quote").alias("source_quote"))


def stems(x: Column) -> Column:
    """Distinct content words without their commonest endings."""
    cut = lambda t: F.coalesce(*[F.when(t.endswith(s) & (F.length(t) - len(s) >= 3), F.substring(t, F.lit(1), F.length(t) - len(s))) for s in ("ing", "ed", "es", "s")], t)
    return F.array_distinct(F.transform(F.filter(text.tokens(x), lambda t: ~t.isin(*STEM_STOP)), cut))


def stem_supported(claim: Column, passage: Column, least: float = 0.5) -> Column:
    """struct(ok, score): the share of the claim's stems in the passage, and every standalone number of it."""
    stated = F.forall(text.standalone_numbers(claim), lambda n: F.contains(F.lower(F.coalesce(passage, F.lit(""))), n))
    share = text.bind(stems(claim), lambda mine: F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, stems(passage))) / F.size(mine)).otherwise(-1.0))
    return text.bind(share, lambda x: F.struct(((x >= F.lit(max(least, 0.0))) & stated).alias("ok"), F.round(F.greatest(x, F.lit(0.0)), 3).alias("score")))


def entailed(claim: Column, passage: Column) -> Column:
    """A verifier that believes everything."""
    return F.struct(F.lit(True).alias("ok"), F.lit(1.0).alias("score"))


def ground(found: DataFrame, verifier: Callable[[Column, Column], Column] = stem_supported) -> DataFrame:
    """Frames with grounding_label and grounding_score: a supported frame scores 1, one without a quote is unknown, the rest keep their overlap."""
    blank = F.trim("source_quote") == ""
    blank = blank & F.lit(verifier is not entailed)
    seen = found.withColumn("__v", verifier(F.coalesce("atomic_claim", "raw_statement"), F.col("source_quote")))
    label = F.when(blank, "unknown").when(F.col("__v.ok"), "entailed").otherwise("contradicted")
    score = F.when(blank, 0.0).when(F.col("__v.ok"), 1.0).otherwise(F.round(F.col("__v.score").cast("double"), 3))
    note = F.when(blank, F.array(F.lit("no_source_quote"))).when(~F.col("__v.ok"), F.array(F.concat(F.lit("grounding_overlap="), F.round("__v.score", 3).cast("string")))).otherwise(F.array().cast(_EMPTY))
    return seen.withColumn("grounding_label", label).withColumn("grounding_score", score).withColumn("warnings", F.concat("warnings", note)).drop("__v")


def gate(grounded: DataFrame, require: bool = True, least: float = 0.8) -> Column:
    """Why a grounded frame is not used; null if it is."""
    return F.when(F.lit(require) & (F.col("grounding_label") != "entailed"), "grounding_failed").when(F.col("grounding_score") < least, "grounding_below_threshold")


def relation(mode: Column, direction: Column) -> Column:
    """The edge's relation; null for no change."""
    return F.when(mode == "descriptive_marker", "DEFINES_OR_MARKS").when(mode == "descriptive_expression", "DESCRIPTIVE_EXPRESSION").otherwise(F.try_element_at(text.constant_map(RELATIONS), direction))


def sign(rel: Column) -> Column:
    return F.when(rel.isin("INCREASES_READOUT", "ASSOCIATED_WITH_HIGHER_READOUT"), 1).when(rel.isin("DECREASES_READOUT", "ASSOCIATED_WITH_LOWER_READOUT"), -1).otherwise(0)


def edges(used: DataFrame) -> DataFrame:
    """Signed edges of frames: a descriptive readout points to its cell type, an anchor to its readout; others have no place in the graph."""
    described = F.col("evidence_mode").isin("descriptive_marker", "descriptive_expression")
    rows = used.withColumn("relation", relation(F.col("evidence_mode"), F.col("direction"))).withColumn("source", F.when(described, F.col("readout")).otherwise(F.col("anchor"))).withColumn("target", F.when(described, F.col("cell")).otherwise(F.col("readout")))
    rows = rows.where("relation IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL")
    return rows.select(F.col("frame_id").alias("edge_id"), F.col("source.entity_id").alias("src"), F.col("target.entity_id").alias("dst"), "source", "target", "relation", sign(F.col("relation")).alias("sign"), "direction", "context", "evidence_mode", "grounding_score", "parser_confidence", "paper_id", "idx", "k", "source_quote", "raw_statement")


def nodes(graph: DataFrame) -> DataFrame:
    """node, label, type, species of every end of an edge; of several spellings the last by paper and place."""
    ends = graph.select(F.explode(F.array(F.struct(F.struct("paper_id", "idx", "k", F.lit(0)).alias("at"), F.col("source").alias("e")), F.struct(F.struct("paper_id", "idx", "k", F.lit(1)).alias("at"), F.col("target").alias("e")))).alias("x"))
    return ends.groupBy(F.col("x.e.entity_id").alias("node")).agg(F.max_by("x.e", "x.at").alias("e")).select("node", F.col("e.name").alias("label"), "e.type", "e.species")


def signature_index(records: DataFrame) -> DataFrame:
    """gene (normalised), name, genes, species of every signature with genes."""
    rows = records.select(F.array_join("species", " ").alias("species"), F.explode("signatures").alias("s")).withColumn("genes", F.filter(F.coalesce("s.genes", F.array().cast(_EMPTY)), lambda g: F.coalesce(g, F.lit("")) != ""))
    return rows.where(F.size("genes") > 0).select(F.explode("genes").alias("g"), F.coalesce("s.name", F.lit("")).alias("name"), "genes", "species").select(text.normalize(F.col("g")).alias("gene"), "name", "genes", "species")
