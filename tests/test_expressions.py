"""Column expressions on literal cases."""

import pytest
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import query as Q
from corpusloom.functions import text as T
from corpusloom.operators import evaluation as V
from corpusloom.operators import index as I
from corpusloom.operators import retrieval as R
from corpusloom.operators import synthesis as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def cases():
    return [
        (T.normalize_line(F.lit(" • a  b\tc ")), "a b c"),
        (T.normalize_line(F.lit(None).cast("string")), ""),
        (T.frequency_key(F.lit("Page 3 of 12  SOP 44")), "sop #"),
        (T.is_heading(F.lit("Annex 11")), True),
        (T.is_heading(F.lit("2.1 Quality System")), True),
        (T.is_heading(F.lit("QUALITY RISK MANAGEMENT")), True),
        (T.is_heading(F.lit("plain words here")), False),
        (T.is_artifact(F.lit("page 7 / 12")), True),
        (T.is_artifact(F.lit("https://a.b")), True),
        (T.is_artifact(F.lit("......")), True),
        (T.is_artifact(F.lit("a sentence")), False),
        (T.clean_title(F.lit(" - Untitled - ")), ""),
        (T.clean_title(F.lit("Quality Manual.")), "Quality Manual"),
        (T.split_sentences(F.lit("One. Two! Three")), ["One.", "Two!", "Three"]),
        (T.clean_text(F.lit("21 CFR 211 here")), "21 CFR here"),
        (T.is_noisy(F.lit("short")), True),
        (T.similarity_key(F.lit("A1 b-c, 22 D!")), "a b c d"),
        (T.has_requirement(F.lit("It requires nothing")), False),
        (T.has_requirement(F.lit("Records must be kept")), True),
        (T.is_boilerplate(F.lit("This guidance represents our thinking")), True),
        (T.looks_like_heading(F.lit("Scope of work")), True),
        (T.trim_words(F.lit("one two three four five of the"), 6), "one two three four five."),
        (T.trim_words(F.lit("a b c d"), 3), ""),
        (T.capitalize_first(F.lit("- été")), "- Été"),
        (T.normalize_acronyms(F.lit("fda and pic / s")), "FDA and PIC/S"),
        (T.looks_truncated(F.lit("kept with.")), True),
        (T.normalize_query(F.lit("  WhAt   IS   GMP??  ")), "what is gmp?"),
        (T.normalize_query(F.lit("Data   integrity!!!   ")), "data integrity!"),
        (Q.expand(F.lit("GMP validation requirements")), ["gmp validation requirements", "good manufacturing practice validation requirements"]),
        (Q.expand(F.lit("")), [""]),
        (Q.broad_requirement(F.lit("What does GMP require for validation?")), True),
        (Q.broad_requirement(F.lit("How to handle GMP steps that are required")), False),
        (Q.intent(F.lit("What is CAPA?")), "definition"),
        (Q.intent(F.lit("How should we proceed")), "procedure"),
        (Q.doc_hints(F.lit("ICH Q 9 (R1) and Part 11")), ["part11", "q9"]),
        (Q.live_data(F.lit("Who is the head of the agency?")), True),
        (Q.live_data(F.lit("What is validation?")), False),
        (Q.triggers(F.lit("audit trail and root cause")), ["data_integrity", "deviation"]),
        (Q.anchors(F.lit("nothing here")), []),
        (R.requirement_hits(F.lit("shall must, must; shalls in accordance  with")), 3),
        (R.requirement_boost(F.lit(2)), 0.01),
        (R.requirement_boost(F.lit(0)), 0.0),
        (R.in_scope(F.lit("ema"), F.lit("PIC_S")), True),
        (R.in_scope(F.lit("FDA"), F.lit("ICH")), False),
        (R.in_scope(F.lit("odd"), F.lit("ICH")), True),
        (R.fallback_match(F.lit("process validation"), F.lit("Process-Validation.pdf")), True),
        (S.confidence(F.lit(3), F.lit(2), F.lit(0.25)), "High"),
        (S.confidence(F.lit(2), F.lit(1), F.lit(0.22)), "Medium"),
        (S.confidence(F.lit(1), F.lit(1), F.lit(0.40)), "Low"),
        (V.short_sources(F.lit("a:1;b:2;c:3")), "a:1; b:2; ..."),
        (V.safe_id(F.lit("a b/c")), "a_b_c"),
        (V.extract_json(F.lit('noise {"a": 1} tail')), '{"a": 1}'),
        (V.extract_json(F.lit("none")), None),
        (V.balance_reason(F.array(F.lit("EU"), F.lit("FDA")), F.array(F.lit("EU"), F.lit("FDA")), F.array(F.lit("FDA"))), "phase_a_balance_missing:EU"),
        (I.char_terms(F.lit("ab")), [" ab", "ab ", " ab "]),
        (I.char_terms(F.lit("a")), [" a "]),
        (I.word_terms(F.lit("the Red fox a"), ("the",)), ["red", "fox", "red fox"]),
    ]


def test_expressions(spark):
    """All cases in one row; the message lists those that differ."""
    found = spark.range(1).select(*[c.alias(f"v{i}") for i, (c, _) in enumerate(cases())]).first()
    assert [(i, found[i], want) for i, (_, want) in enumerate(cases()) if found[i] != want] == []


LEX = {k: C.Lexicon((), ()) for k in C.DOMAIN_PRIORITY} | {
    "deviations": C.Lexicon(("deviation", "capa"), ("record",), ("audit trail",)),
    "apr": C.Lexicon(("annual product review",), ("trend",)),
    "validation": C.Lexicon(("process validation",), ("protocol",)),
}


@pytest.mark.parametrize(
    "question,want",
    [("How is a deviation handled?", "deviations"), ("OOS and annual product review", "deviations"), ("annual product review trend", "apr"), ("validation", "validation"), ("trend", None), ("", None)],
)
def test_domain(spark, question, want):
    assert one(spark, Q.domain(F.lit(question), LEX)) == want


def test_lexicon_passes(spark):
    assert one(spark, Q.passes(F.lit("A CAPA was raised"), LEX["deviations"]))
    assert not one(spark, Q.passes(F.lit("A CAPA in the audit trail"), LEX["deviations"]))
    assert not one(spark, Q.passes(F.lit("one record"), LEX["deviations"]))
