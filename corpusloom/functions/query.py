"""Question expressions: expansion, predicates, hints, intent and domain."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as T


def _strings(*items: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*items), lambda x: x.isNotNull() & (x != "")))


def expand(q: Column, synonyms=C.SYNONYMS, acronyms=C.ACRONYMS, most: int = 4) -> Column:
    """The normalised question first, then its forms with a synonym or an acronym written out; distinct, `most` extras."""
    base = T.normalize_query(q)
    extras = [F.when(base.contains(a), T.normalize_query(F.replace(base, F.lit(a), F.lit(b)))) for a, b in synonyms]
    extras += [F.when(base.rlike(rf"\b{a}\b"), T.normalize_query(F.regexp_replace(base, rf"\b{a}\b", b))) for a, b in acronyms]
    return F.when(base == "", F.array(base)).otherwise(F.slice(_strings(base, *extras), 1, most + 1))


def broad_requirement(q: Column, marker: str = "gmp", include=C.BROAD_INCLUDE, exclude=C.BROAD_EXCLUDE) -> Column:
    s = T.normalize_query(q)
    return s.rlike(rf"\b{marker}\b") & s.rlike(T.any_word(include)) & ~T.contains_any(s, exclude)


def variants(q: Column, anchors=C.BROAD_ANCHORS, synonyms=C.SYNONYMS, acronyms=C.ACRONYMS, broad: Column | None = None, target=("continuous processing", "continuous manufacturing", "ich q13", r"\bich\s*q\s*13\b")) -> Column:
    """All forms a question is searched in: expansions, the targeted form, and the form with broad anchors."""
    base = T.normalize_query(q)
    asked, wanted, tag, tagged = target
    aimed = F.when(base.contains(wanted), base).otherwise(F.concat(base, F.lit(" " + wanted)))
    aimed = F.when(aimed.rlike(tagged), aimed).otherwise(F.concat(aimed, F.lit(" " + tag)))
    aimed = F.when(base.contains(asked), T.normalize_query(aimed))
    wide = broad_requirement(q) if broad is None else broad
    widened = F.when(wide, T.normalize_query(F.concat(base, F.lit(" " + " ".join(anchors)))))
    none = F.array().cast("array<string>")
    extra = F.concat(F.when(aimed.isNotNull(), F.array(aimed)).otherwise(none), F.when(widened.isNotNull(), F.array(widened)).otherwise(none))
    return F.array_distinct(F.concat(expand(q, synonyms, acronyms), extra))


def intent(q: Column, definition=("what is", "define"), defines=("constitutes",), procedure=("how should", "steps", "investigat", "handle", "document"), requirement=("required", "requirements", "expectations", "must")) -> Column:
    s = F.lower(F.btrim(F.coalesce(q, F.lit(""))))
    starts = F.lit(False)
    for d in definition:
        starts = starts | s.startswith(d)
    return F.when(starts | T.contains_any(s, defines), "definition").when(T.contains_any(s, procedure), "procedure").when(T.contains_any(s, requirement), "requirements").otherwise("unknown")


def doc_hints(q: Column) -> Column:
    """Document marks named in a question: q9, part11 and the like."""
    s = F.lower(F.coalesce(q, F.lit("")))
    a = F.transform(F.regexp_extract_all(s, F.lit(r"\bq\s*[- ]?(\d{1,2})(?:\s*\(r\d+\))?\b"), 1), lambda x: F.concat(F.lit("q"), x))
    b = F.transform(F.regexp_extract_all(s, F.lit(r"\bpart\s*(\d{1,3})\b"), 1), lambda x: F.concat(F.lit("part"), x))
    return F.array_sort(F.array_distinct(F.concat(a, b)))


def live_data(q: Column) -> Column:
    """Questions that ask for facts that no corpus holds: prices, office holders, current rates."""
    s = F.lower(F.btrim(F.coalesce(q, F.lit(""))))
    rate = s.contains("failure rate") & (s.contains("current") | s.rlike(r"\b20\d{2}\b"))
    office = s.contains("who is") & s.contains("head of")
    letters = s.contains("how many") & s.contains("warning letter") & s.contains("last month")
    return s.contains("market share") | s.contains("average cost") | rate | office | letters


def triggers(q: Column, table: Mapping[str, tuple[str, ...]] = C.TRIGGERS) -> Column:
    """Names of the topics whose trigger terms the question holds, in the table's order."""
    s = T.alnum_only(q)
    return F.filter(F.array(*[F.when(T.contains_any(s, terms), F.lit(name)) for name, terms in table.items()]), lambda x: x.isNotNull())


def anchors(q: Column, table: Mapping[str, tuple[str, ...]] = C.TRIGGERS, terms: Mapping[str, tuple[str, ...]] = C.ANCHORS) -> Column:
    """Anchor terms of all triggered topics, each once, in order."""
    s = T.alnum_only(q)
    none = F.array().cast("array<string>")
    lists = [F.when(T.contains_any(s, table[k]), F.array(*[F.lit(t) for t in terms[k]])).otherwise(none) for k in table]
    return F.array_distinct(F.flatten(F.array(*lists)))


def domain(q: Column, lexicon: Mapping[str, C.Lexicon] = C.LEXICONS, priority=C.DOMAIN_PRIORITY, out_of_spec=C.OUT_OF_SPEC, apr=C.APR_PRIMARY, validation=C.VALIDATION_DOMAIN) -> Column:
    """The domain whose terms the question holds most (3 per strong, 1 per secondary), earlier ones first on ties.

    Out-of-specification terms settle on deviations; the review domain needs its own terms and none of those; validation
    terms count for one at least.
    """
    return T.let(T.normalize_query(q), lambda s: _domain(s, lexicon, priority, out_of_spec, apr, validation))


def _domain(s: Column, lexicon, priority, out_of_spec, apr, validation) -> Column:
    oos = T.contains_any(s, out_of_spec) | (s.contains("phase i") & s.contains("phase ii"))
    review = T.contains_any(s, apr) & ~oos
    valid = T.contains_any(s, validation)
    scored = []
    for rank, name in enumerate(priority):
        score = 3 * T.count_terms(s, lexicon[name].strong) + T.count_terms(s, lexicon[name].secondary)
        if name == "apr":
            score = F.when(review, score).otherwise(F.lit(0))
        if name == "validation":
            score = F.when(valid, F.greatest(score, F.lit(1))).otherwise(score)
        scored.append(F.struct((-score).alias("s"), F.lit(rank).alias("r"), F.lit(name).alias("name")))
    best = F.array_min(F.array(*scored))
    return F.when(s == "", F.lit(None)).when(oos, "deviations").when(best["s"] < 0, best["name"]).when(review, "apr").when(valid, "validation")


def lexicon_flags(text: Column, lex: C.Lexicon) -> tuple[Column, Column, Column]:
    """(strong, secondary, negative) hits of a text."""
    hits = T.let(T.collapsed(text), lambda s: F.array(*[T.count_terms(s, x) for x in (lex.strong, lex.secondary, lex.negative)]))
    return hits[0], hits[1], hits[2]


def passes(text: Column, lex: C.Lexicon) -> Column:
    strong, secondary, negative = lexicon_flags(text, lex)
    return (T.collapsed(text) != "") & (negative == 0) & ((strong >= lex.min_strong) | (secondary >= lex.min_secondary))
