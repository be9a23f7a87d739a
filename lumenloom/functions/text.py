"""Text normalisation and parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda",
    "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "Α": "alpha", "Β": "beta", "Γ": "gamma", "Δ": "delta", "Κ": "kappa", "Λ": "lambda", "Μ": "mu", "Σ": "sigma", "Ω": "omega",
}
LABELS = ("RELEVANT", "BORDERLINE", "NOT_RELEVANT")
DEFAULT_SCORES = {"RELEVANT": 0.8, "BORDERLINE": 0.5, "NOT_RELEVANT": 0.1, "UNKNOWN": 0.3}
QUANTITY_QUALIFIERS = (
    "approximately", "approx", "about", "around", "roughly", "nearly", "circa", "ca", "between", "to", "and", "or", "x", "over", "under", "up", "down",
    "greater", "less", "than", "above", "below", "more", "fewer", "exceeding", "most", "least", "at", "no", "not",
)
STOP_WORDS = (
    "the", "and", "for", "with", "were", "was", "are", "this", "that", "from", "into", "which", "not", "have", "has", "used", "using", "our", "your", "per",
)


def bind(x: Column, use) -> Column:
    """``use`` of a value that is computed once, however often a lambda asks for it."""
    return F.transform(F.array(x), use)[0]


def empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def norm_doi(x: Column) -> Column:
    """Bare lower-case DOI; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(x)), r"^https?://(dx\.)?doi\.org/", "")
    return empty_to_null(F.trim(F.regexp_replace(bare, "^doi:", "")))


def norm_arxiv(x: Column) -> Column:
    """arXiv id without scheme and version."""
    return empty_to_null(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "^arxiv:", ""), r"v\d+$", ""))


def canonical_id(doi: Column, arxiv: Column, pmid: Column, s2: Column) -> Column:
    """Id by the strongest identifier; null if there is none."""
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("arxiv:"), arxiv), F.concat(F.lit("pmid:"), pmid), F.concat(F.lit("s2:"), s2))


def canonical_url(url: Column) -> Column:
    """Host and path: scheme, ``www.``, query, fragment and a trailing slash removed."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), "/$", "")


def safe_id(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]", "_")


def slug(x: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(empty_to_null(joined), F.lit("unknown"))


def entity_id(kind: Column, species: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, F.coalesce(empty_to_null(species), F.lit("na")), slug(name))


def constant_map(pairs: dict) -> Column:
    """A map of string literals (values: strings or tuples of strings) as one expression, which the optimiser folds to a constant."""
    quoted = lambda x: "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    said = lambda v: "array(" + ", ".join(map(quoted, v)) + ")" if isinstance(v, tuple) else quoted(v)
    return F.expr("map(" + ", ".join(x for k, v in pairs.items() for x in (quoted(k), said(v))) + ")")


def fold_greek(x: Column) -> Column:
    """Greek letters by their names; a text without any is left as it is."""
    letters = F.transform(F.regexp_extract_all(x, F.lit("(?s)(.)"), 1), lambda c: F.coalesce(F.try_element_at(constant_map(GREEK), c), c))
    return F.when(x.rlike("[" + "".join(GREEK) + "]"), F.array_join(letters, "")).otherwise(x)


def squeeze(x: Column) -> Column:
    """White space of any kind to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize(x: Column) -> Column:
    """Greek folded, squeezed, lower-cased, edge punctuation removed."""
    return F.regexp_replace(F.lower(squeeze(fold_greek(x))), r"^[ .,:;()\[\]{}]+|[ .,:;()\[\]{}]+$", "")


def tokens(x: Column, least: int = 3) -> Column:
    """Distinct lower-case alphanumeric tokens of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) >= least))


def content_words(x: Column) -> Column:
    return F.array_except(tokens(x), F.array(*map(F.lit, STOP_WORDS)))


def numbers(x: Column) -> Column:
    """Unanchored numbers, sorted as strings."""
    return F.array_sort(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1))


def standalone_numbers(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?<![A-Za-z0-9])(\d+(?:\.\d+)?)(?![A-Za-z0-9])"), 1)


def units(x: Column) -> Column:
    words = F.regexp_extract_all(F.lower(x), F.lit("([a-zµμ]+|[%‰:/])"), 1)
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*map(F.lit, QUANTITY_QUALIFIERS)))))


def direction(x: Column) -> Column:
    """Comparator class: lt, gt, le, ge or empty."""
    low = F.lower(x)
    word = lambda names: low.rlike(rf"(?<![a-z])({names})(?![a-z])")
    return (
        F.when(x.rlike("[≤⩽]"), "le").when(x.rlike("[≥⩾]"), "ge").when(x.contains("<"), "lt").when(x.contains(">"), "gt")
        .when(low.rlike("up to|at most|no more than|not more than"), "le").when(low.rlike("at least|no less than"), "ge")
        .when(word("below|under|less|fewer"), "lt").when(word("above|over|greater|more|exceeding"), "gt").otherwise("")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def number_match(a: Column, b: Column) -> Column:
    """Relaxed match of two quantities: numbers, units and direction agree; without numbers, half the tokens."""
    na, nb = numbers(a), numbers(b)
    qualitative = (F.size(na) == 0) & (F.size(nb) == 0)
    return F.when(qualitative, jaccard(tokens(a, 1), tokens(b, 1)) >= 0.5).otherwise((na == nb) & (units(a) == units(b)) & (direction(a) == direction(b)))


def entity_match(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def parse_label(text: Column) -> Column:
    """Label of a model's answer: the first label-like of its first four tokens, else wherever one stands."""
    up = F.regexp_replace(F.upper(F.trim(text)), "[^A-Z_ ]", " ")
    head = F.slice(F.array_remove(F.split(up, r"\s+"), ""), 1, 4)
    first = F.try_element_at(F.filter(head, lambda t: t.isin("NOT", "NOT_RELEVANT", "BORDERLINE", "RELEVANT")), F.lit(1))
    return (
        F.when(first.isin("NOT", "NOT_RELEVANT"), "NOT_RELEVANT").when(first.isNotNull(), first)
        .when(up.contains("NOT RELEVANT") | up.contains("NOT_RELEVANT"), "NOT_RELEVANT").when(up.contains("BORDERLINE"), "BORDERLINE").when(up.contains("RELEVANT"), "RELEVANT").otherwise("UNKNOWN")
    )


def parse_score(text: Column, label: Column) -> Column:
    """Score 0 to 1 of an answer, or its label's default."""
    found = F.regexp_extract(text, r"(?<!\d)(0?\.\d+|1\.0+|0|1)(?!\d)", 1).try_cast("double")
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_SCORES.items() for x in kv])
    return F.coalesce(F.when(found.between(0, 1), found), F.try_element_at(default, label), F.lit(0.3))


def chunks(x: Column, size: int = 800, overlap: int = 120) -> Column:
    """Overlapping pieces of a text; a short text whole, blank pieces left out."""
    step = max(1, size - overlap)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(x, i + 1, F.lit(size)))
    pieces = F.when(F.length(x) <= size, F.array(x)).otherwise(cut)
    return F.filter(F.coalesce(pieces, F.array().cast("array<string>")), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) != "")


def money(cents: Column) -> Column:
    return F.format_string("$%,.2f", cents / 100)


def supported(claim: Column, passage: Column, least: float = 0.5) -> Column:
    """struct(ok, score): the share of the claim's content words in the passage, and every standalone number in it."""
    words = content_words(claim)
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, content_words(passage))) / F.size(words)).otherwise(0.0)
    stated = F.forall(standalone_numbers(claim), lambda n: F.contains(F.lower(F.coalesce(passage, F.lit(""))), n))
    return F.struct(((F.size(words) > 0) & (share >= least) & stated).alias("ok"), F.round(share, 3).alias("score"))


def quote_in_source(quote: Column, source: Column) -> Column:
    q = F.lower(squeeze(quote))
    return F.coalesce((q != "") & F.contains(F.lower(squeeze(source)), q), F.lit(False))
