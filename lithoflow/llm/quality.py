"""Quality rules by distribution divergence: character classes and common words against language references."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.common import durable, map_texts, table

#: Fixed lists of common words by language, for which the common-word histograms count unless other lists are given.
COMMON = {
    "de": "der die das und in zu den ist von mit sich des auf für nicht ein eine als auch es an im dem".split(),
    "en": "the of and to in a is that it for on was with as are be this by from at or an he have".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
    "fr": "de la le et les des en un une du est que qui dans pour par sur au avec il ne pas ce à".split(),
}
#: Classes of characters: lower, upper, digit, white space, symbol, other ASCII, beyond ASCII.
CLASSES = 7
SYMBOLS = b"#*$%&|<>"
#: Words that a text needs before a distribution counts against it.
MIN_WORDS_CLASSES, MIN_WORDS_COMMON = 50, 150
#: Jensen-Shannon distances (0 to 1) to the nearest reference, beyond which a text is rejected.
MAX_CLASSES, MAX_COMMON = 0.28, 0.6
#: Base rules: the least words, and the greatest share in percent of words in repeated windows.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
#: Languages of a table at most: each is one row of counts at the driver. More are an error.
LANGUAGES = 1000

_FEATURES = [(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("__classes", T.ArrayType(T.LongType())), ("__common", T.ArrayType(T.LongType()))]


def _class_table() -> np.ndarray:
    """Byte to class; continuation bytes of UTF-8 are no characters and get CLASSES."""
    out = np.full(256, 5, np.uint8)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[list(b" \t\n\r\x0b\x0c")] = 3
    out[list(SYMBOLS)] = 4
    out[0x80:0xC0], out[0xC0:] = CLASSES, 6
    return out


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """For each document the words that lie in a window found twice or more in it.

    ids: words' numbers, document after document; windows (a power of two of words) get numbers by doubling.
    """
    covered = np.zeros(len(ids) + 1, np.int64)
    rank, width = ids.astype(np.int64), 1
    while width < window and len(rank) > width:
        key = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(key, return_inverse=True)[1]
        width *= 2
    if width < window or not len(rank):
        return np.zeros(n_docs, np.int64)
    whole = np.nonzero(doc[: len(rank)] == doc[window - 1 : window - 1 + len(rank)])[0]
    _, where, n = np.unique(doc[whole] * (int(rank.max()) + 1) + rank[whole], return_inverse=True, return_counts=True)
    start = whole[n[where] > 1]
    np.add.at(covered, start, 1)
    np.add.at(covered, start + window, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return np.bincount(doc[inside], minlength=n_docs)


def listed(common: dict[str, list[str]]) -> list[str]:
    """All words of the lists, in order: the bins of a common-word histogram but its last, which holds all other words."""
    return sorted({w for words in common.values() for w in words})


def measure(known: list[str]):
    """Function from texts to the feature columns."""
    of_byte = _class_table()
    place = {w.encode(): i for i, w in enumerate(known)}

    def rows(texts: list[bytes | None]):
        out: list[list] = [[] for _ in _FEATURES]
        number: dict[bytes, int] = {}
        ids: list[int] = []
        sizes: list[int] = []
        for t in texts:
            t = t or b""
            words = t.split()
            ids += [number.setdefault(w, len(number)) for w in words]
            sizes.append(len(words))
            classes = np.bincount(of_byte[np.frombuffer(t, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
            lines = [x for x in t.split(b"\n") if x.strip()]
            common = [0] * (len(known) + 1)
            for w, n in Counter(filter(place.__contains__, t.lower().split())).items():
                common[place[w]] = n
            common[-1] = len(words) - sum(common)
            out[0].append(len(words))
            out[1].append(int(classes.sum() - classes[3]))
            out[2].append(int(classes[4]))
            out[3].append(len(lines) - len(set(lines)))
            out[5].append(classes.tolist())
            out[6].append(common)
        doc = np.repeat(np.arange(len(texts)), sizes)
        out[4] = repeated_words(np.array(ids, np.int64), doc, len(texts)).tolist()
        return out

    return rows


def features(docs: DataFrame, keep: list[str], text: str = "text", common: dict[str, list[str]] = COMMON) -> DataFrame:
    known = listed(common)
    return map_texts(docs, text, keep, _FEATURES, lambda: measure(known))


def references(measured: DataFrame, lang: str, bins: int) -> dict[str, tuple[list[float], list[float]]]:
    """Summed class and common-word counts of all rows of each language in the table: one row a language."""
    sums = [F.sum(F.col("__classes")[i]).alias(f"k{i}") for i in range(CLASSES)] + [F.sum(F.col("__common")[i]).alias(f"w{i}") for i in range(bins)]
    got = measured.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(*sums).limit(LANGUAGES + 1).collect()
    if len(got) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r["lang"]: ([float(r[f"k{i}"]) for i in range(CLASSES)], [float(r[f"w{i}"]) for i in range(bins)]) for r in got}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts p to the counts q; 0 where a side is empty."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    total = p.sum(1)
    if q.sum() == 0:
        return np.zeros(len(p))
    p, q = p / np.maximum(total, 1)[:, None], (q / q.sum())[None, :]
    m = (p + q) / 2
    half = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    return np.where(total > 0, np.sqrt(np.clip((half(p) + half(q)) / 2, 0, 1)), 0)


def quality(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", max_classes: float = MAX_CLASSES, max_common: float = MAX_COMMON, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, common: dict[str, list[str]] = COMMON, guards: tuple[int, int] = (MIN_WORDS_CLASSES, MIN_WORDS_COMMON)) -> DataFrame:
    """keep's columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_classes, js_common.

    References are the summed histograms of all rows of a language, one for every language of the table; a text is held
    against the nearest of them, so its own language doesn't matter. common: lists of words, by language, whose counts
    make up the second histogram; languages without a list have a reference over the same words. Without any row with a language
    nothing is rejected but by the base rules. A text of fewer words than guards (classes, common words) is not judged by that distribution. Null and empty texts have no word and fail the
    base rules. Repeated rows are judged one by one; columns that aren't kept don't matter, and kept ones named like a result give way to it.
    """
    same = "__lang"
    keep = [k for k in keep if k not in (*(n for n, _ in _FEATURES), "base_failed", "kept", "js_classes", "js_common")]
    measured = durable(features(docs.withColumn(same, F.col(f"`{lang}`").cast("string")), [*keep, same], text, common))
    known = references(measured, same, len(listed(common)) + 1)
    base = [n for n, _ in _FEATURES[:5]]
    kept_fields = [f for f in measured.schema.fields if f.name in (*keep, *base)]
    schema = T.StructType([*kept_fields, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("js_classes", T.DoubleType()), T.StructField("js_common", T.DoubleType())])

    def judge(frames):
        for frame in frames:
            out = frame[[f.name for f in kept_fields]].copy()
            n = frame["n_words"].to_numpy()
            far = {}
            for j, column in enumerate(("__classes", "__common")):
                counts = np.stack(frame[column].to_numpy()) if len(frame) else np.zeros((0, 1))
                far[column] = np.min([js_distance(counts, np.array(r[j])) for r in known.values()], axis=0) if known and len(frame) else np.zeros(len(frame))
            out["base_failed"] = (n < min_words) | (100 * frame["n_repeat_words"].to_numpy() > max_repeated * n)
            bad = (n >= guards[0]) & (far["__classes"] > max_classes) | (n >= guards[1]) & (far["__common"] > max_common)
            out["kept"] = ~out["base_failed"] & ~bad
            out["js_classes"], out["js_common"] = far["__classes"], far["__common"]
            yield out

    return measured.mapInPandas(judge, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    columns = ["doc_id", *(n for n, _ in _FEATURES[:5]), "base_failed", "kept"]
    return quality(table(spark, sf_dir, "documents"), ["doc_id"]).select(*columns)


_WORD = r"[^\x20\x09-\x0D]"
_COUNTS = {0: "[^a-z]", 1: "[^A-Z]", 2: "[^0-9]", 3: _WORD, 4: "[^#*$%&|<>]", 6: r"[\x00-\x7F]"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls,
        {", ".join(f"CAST(length(regexp_replace(t, '{p}', '', 'g')) AS BIGINT) AS k{i}" for i, p in _COUNTS.items())} FROM d),
f AS (SELECT *, CAST(len(ws) AS BIGINT) AS n_words, length(t) - k0 - k1 - k2 - k3 - k4 - k6 AS k5 FROM w),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, n_words - {WINDOW - 2})) AS i FROM f WHERE n_words >= {WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, range({WINDOW}) r(j) GROUP BY rid),
common AS (SELECT rid, x, count(*) AS n FROM (SELECT rid, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '{_WORD}+')) AS x FROM f)
        WHERE x IN ({", ".join(f"'{x}'" for x in listed(COMMON))}) GROUP BY rid, x),
bins AS (SELECT rid, 1 AS kind, x AS bin, n FROM common
        UNION ALL SELECT f.rid, 1, '', n_words - coalesce((SELECT sum(n) FROM common c WHERE c.rid = f.rid), 0) FROM f
        {" ".join(f"UNION ALL SELECT rid, 0, '{i}', k{i} FROM f" for i in range(CLASSES))}),
p AS (SELECT rid, kind, bin, n / sum(n) OVER (PARTITION BY rid, kind) AS p FROM bins WHERE n > 0),
q AS (SELECT lang, kind, bin, n / sum(n) OVER (PARTITION BY lang, kind) AS q
      FROM (SELECT lang, kind, bin, sum(n) AS n FROM bins JOIN d USING (rid) WHERE lang IS NOT NULL GROUP BY lang, kind, bin)),
langs AS (SELECT DISTINCT lang FROM q),
js AS (SELECT p.rid, p.kind, l.lang,
        sum(p * log2(2 * p / (p + coalesce(q, 0)))) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + 1 - sum(coalesce(q, 0)) AS twice
      FROM p CROSS JOIN langs l LEFT JOIN q ON q.lang = l.lang AND q.kind = p.kind AND q.bin = p.bin GROUP BY p.rid, p.kind, l.lang),
far AS (SELECT rid, kind, sqrt(greatest(0, min(twice) / 2)) AS far FROM js GROUP BY rid, kind),
out AS (SELECT doc_id, n_words, length(t) - k3 AS word_chars, k4 AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(a.far, 0) AS fc, coalesce(b.far, 0) AS fw
      FROM f LEFT JOIN cov USING (rid) LEFT JOIN far a ON a.rid = f.rid AND a.kind = 0 LEFT JOIN far b ON b.rid = f.rid AND b.kind = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
    AND NOT (n_words >= {MIN_WORDS_CLASSES} AND fc > {MAX_CLASSES} OR n_words >= {MIN_WORDS_COMMON} AND fw > {MAX_COMMON}) AS kept
FROM out
"""
