"""Quality rules in DataFrame operations only: counting rules, then the divergence of a document from language references.

Two histograms are compared with the references of each known language by Jensen-Shannon distance: character classes, and the
shares of common words (all other words being one more class). A document's distance is the smallest over the languages, so a
wrong or missing language label doesn't matter; below a minimum length a histogram says nothing and isn't used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\u000b\f\r"
_SPACE = r"[ \t\n\x0B\f\r]+"

#: Character classes, each taken from what the ones before have left.
CLASSES = (("lower", "[a-z]+"), ("space", _SPACE), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("punctuation", "[.,;:!?'\"()-]+"), ("symbol", r"[\x00-\x7F]+"), ("other", "(?s).+"))
#: Rounded shares of these classes in running prose.
CLASS_SHARES = {
    "en": (0.775, 0.170, 0.028, 0.004, 0.022, 0.001, 0.000),
    "es": (0.755, 0.165, 0.026, 0.004, 0.022, 0.001, 0.027),
    "fr": (0.735, 0.165, 0.026, 0.004, 0.025, 0.001, 0.044),
    "de": (0.765, 0.145, 0.050, 0.004, 0.020, 0.001, 0.015),
}
#: Rounded shares of the most common words among all words.
WORD_SHARES = {
    "en": {"the": 0.062, "of": 0.030, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.021, "that": 0.011, "is": 0.010, "for": 0.009, "it": 0.009, "was": 0.009, "on": 0.007},
    "es": {"de": 0.065, "la": 0.040, "que": 0.032, "el": 0.030, "en": 0.027, "y": 0.025, "a": 0.020, "los": 0.016, "se": 0.012, "del": 0.011, "un": 0.010, "por": 0.009},
    "fr": {"de": 0.050, "la": 0.030, "le": 0.028, "et": 0.025, "les": 0.022, "des": 0.018, "en": 0.016, "un": 0.013, "du": 0.012, "une": 0.012, "que": 0.011, "est": 0.010},
    "de": {"der": 0.034, "die": 0.033, "und": 0.030, "in": 0.018, "den": 0.012, "von": 0.010, "zu": 0.010, "das": 0.010, "mit": 0.009, "sich": 0.008, "des": 0.008, "auf": 0.007},
}


def js_distance(shares: Column, reference: list[float]) -> Column:
    """The square root of the Jensen-Shannon divergence (base 2) of an array of shares from a reference, from 0 to 1."""
    plogp = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    term = lambda p, q: plogp(p) + plogp(q) - (p + q) * F.when(p + q > 0, F.log2((p + q) / 2)).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(shares, F.array(*map(F.lit, reference)), term), F.lit(0.0), lambda t, x: t + x) / 2))


def _wordless_distance(reference: dict[str, float]) -> float:
    """The distance of a text with none of a language's common words."""
    rest = 1 - sum(reference.values())
    return math.sqrt((1 - rest + rest * math.log2(rest) - (1 + rest) * math.log2((1 + rest) / 2)) / 2)


def _repeated_words(grams: Column) -> Column:
    """Words covered by the windows (their starts in order) whose text occurs twice or more."""
    keyed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def covered(s: Column) -> Column:
        n = F.size(s)
        twice = lambda e, j: ((j > 0) & (F.element_at(s, F.greatest(j, F.lit(1)))["g"] == e["g"])) | ((j < n - 1) & (F.element_at(s, F.least(j + 2, n))["g"] == e["g"]))
        return F.array_sort(F.transform(F.filter(s, twice), lambda e: e["i"]))

    starts = F.transform(F.array(keyed), covered)[0]
    steps = lambda p: F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3).cast("long"), lambda t, x: t + x)
    return F.transform(F.array(starts), lambda p: F.when(F.size(p) > 0, steps(p)).otherwise(F.lit(0).cast("long")))[0]


def measure_quality(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = 50, class_chars: int = 200, common_words: int = 100, most_class_distance: float = 0.3, most_word_distance: float = 0.4, most_word_share: float | None = 0.9) -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance (null below ``class_chars`` characters and ``common_words`` words) and kept.

    A text without any common word is only 0.32 to 0.41 away from a language, below ``most_word_distance``. So a text also goes if
    its distance is over ``most_word_share`` of what such a text would have, in every language; None leaves that out.
    A null text has no words and fails; an empty or blank one too. Repeated rows are judged alike, each for itself.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"}
    keep = tuple(c for c in keep if c not in made)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    step = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("__t__"))
    body = F.btrim(F.col("__t__"), F.lit(_SPACES))
    lines = F.filter(F.split("__t__", "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0)
    names = [n for n, _ in CLASSES]
    step = step.withColumns({"__w__": F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, _SPACE)), "__l__": lines, "__r0__": F.regexp_replace("__t__", CLASSES[0][1], "")})
    for k in range(1, len(CLASSES) - 1):
        step = step.withColumn(f"__r{k}__", F.regexp_replace(f"__r{k - 1}__", CLASSES[k][1], ""))
    lengths = [F.length("__t__"), *(F.length(f"__r{k}__") for k in range(len(CLASSES) - 1)), F.lit(0)]
    every = sorted({w for ws in WORD_SHARES.values() for w in ws})
    plain = F.split(F.lower("__t__"), r"[ \t\n\x0B\f\r.,;:!?'\"()]+")
    common = F.concat(F.lit(" "), F.array_join(F.filter(plain, lambda x: x.isin(*every)), "  "), F.lit(" "))
    n = F.size("__w__")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get("__w__", i), F.get("__w__", i + 1), F.get("__w__", i + 2)))).otherwise(F.array().cast("array<string>"))
    step = step.select(
        *[F.col(f"`{c}`") for c in keep],
        n.cast("long").alias("n_words"),
        (lengths[0] - (lengths[1] - lengths[2])).cast("long").alias("word_chars"),
        (F.length("__t__") - F.length(F.regexp_replace("__t__", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__l__") - F.size(F.array_distinct("__l__"))).cast("long").alias("n_dup_lines"),
        *[(lengths[k] - lengths[k + 1]).alias(f"__c_{name}__") for k, name in enumerate(names)],
        F.length("__t__").alias("__n__"),
        common.alias("__common__"),
        grams.alias("__g__"),
    )
    step = step.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("__g__")) < F.size("__g__"), _repeated_words(F.col("__g__"))).otherwise(F.lit(0).cast("long"))).drop("__g__")
    of = lambda w: (F.length("__common__") - F.length(F.replace(F.col("__common__"), F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)
    counted = F.array(*[of(w) / F.greatest(F.col("n_words"), F.lit(1)) for w in every])
    step = step.withColumns({"__words__": counted, "__classes__": F.array(*[F.col(f"__c_{x}__") / F.greatest(F.col("__n__"), F.lit(1)) for x in names])})
    by_class = F.least(*[js_distance(F.col("__classes__"), list(q)) for q in CLASS_SHARES.values()])

    def by_words(reference: dict[str, float]) -> Column:
        own = F.array(*[F.get("__words__", every.index(w)) for w in reference])
        return js_distance(F.concat(own, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(own, F.lit(0.0), lambda t, x: t + x)))), [*reference.values(), 1 - sum(reference.values())])

    share = lambda ref: by_words(ref) / F.lit(_wordless_distance(ref))
    few = F.lit(False) if most_word_share is None else (F.col("n_words") >= common_words) & (F.least(*map(share, WORD_SHARES.values())) > most_word_share)
    step = step.withColumn("__few__", few)
    step = step.withColumns({"base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")), "class_distance": F.when(F.col("__n__") >= class_chars, by_class), "word_distance": F.when(F.col("n_words") >= common_words, F.least(*map(by_words, WORD_SHARES.values())))})
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > most_class_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > most_word_distance) | F.col("__few__")
    return step.withColumn("kept", ~F.col("base_failed") & ~far).select(*[F.col(f"`{c}`") for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return measure_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_distance", "word_distance")


def _sql() -> str:
    """The query in DuckDB's SQL, with the references of this module written in."""
    words = sorted({w for ws in WORD_SHARES.values() for w in ws})
    rests, rest = [], "t"
    for name, pattern in CLASSES[:-1]:
        rest = "regexp_replace({}, '{}', '', 'g')".format(rest, pattern.replace("'", "''"))
        rests.append(f"length({rest})")
    shares = ", ".join(f"({a} - {b}) / greatest(length(t), 1)" for a, b in zip(["length(t)", *rests], [*rests, "0"], strict=True))
    counts = ", ".join(f"len(list_filter(plain, lambda x: x = '{w}')) / greatest(len(w), 1)" for w in words)
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END"
    js = "sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}::DOUBLE[]), lambda z: " + term.format("z[1]") + " + " + term.format("z[2]") + " - CASE WHEN z[1] + z[2] > 0 THEN (z[1] + z[2]) * log2((z[1] + z[2]) / 2) ELSE 0 END)) / 2))"
    by_class = ", ".join(js.format(p="cs", q=list(q)) for q in CLASS_SHARES.values())
    own = {lang: "[" + ", ".join(f"ws[{words.index(w) + 1}]" for w in ref) + "]" for lang, ref in WORD_SHARES.items()}
    word = {lang: js.format(p=f"list_append({own[lang]}, greatest(0.0, 1 - list_sum({own[lang]})))", q=[*ref.values(), 1 - sum(ref.values())]) for lang, ref in WORD_SHARES.items()}
    by_word, by_share = ", ".join(word.values()), ", ".join(f"{w} / {_wordless_distance(WORD_SHARES[lang])}::DOUBLE" for lang, w in word.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, regexp_split_to_array(lower(t), '[ \t\n\x0B\f\r.,;:!?''"()]+') AS plain FROM d),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 3)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, [{shares}] AS cs, [{counts}] AS ws FROM w LEFT JOIN r USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN length(t) >= 200 THEN least({by_class}) ELSE 0 END AS cd, CASE WHEN n_words >= 100 THEN least({by_word}) ELSE 0 END AS wd, CASE WHEN n_words >= 100 THEN least({by_share}) ELSE 0 END AS word_share FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND cd <= 0.3 AND wd <= 0.4 AND word_share <= 0.9 AS kept FROM j
"""


OP8_SQL = _sql()
