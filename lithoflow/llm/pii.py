"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

The main path has only DataFrame expressions. What comes to the driver are counts of vote patterns, at most
len(KINDS) * 3 ** len(LABELERS) rows; the fit of a few dozen numbers to them is plain arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.llm.common import durable, table

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns of base spans, with possessive quantifiers and look-behinds: the same matches in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns of candidates that no base pattern finds: written-out, bracketed or oddly separated.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\s?(?:\[at\]|\(at\)|\{at\}|@)\s?[a-z0-9-]{1,63}+(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[a-z0-9-]{2,63}+){1,4}+|\sat\s[a-z0-9-]{1,63}+(?:\sdot\s[a-z0-9-]{2,63}+){1,4}+)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\s?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
#: What a text must hold for a kind's patterns to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Fixed gazetteers: ends of host names, first digits of card numbers, country and area codes, first octets in use.
HOST_ENDS = "com org net edu gov io de fr es uk eu info biz me co us ch at nl it example".split()
#: Fixed context words of the four languages, by kind, and words before numbers that are no personal data.
CONTEXT = {
    "email": "mail|e-mail|email|contact|write|correo|courriel|kontakt|adresse|address",
    "ip": "ip|server|host|address|login|addr|adresse|servidor|serveur",
    "card": "card|visa|mastercard|credit|payment|karte|kreditkarte|carte|tarjeta|paid",
    "phone": "phone|tel|call|mobile|fax|telefon|anruf|handy|téléphone|appel|teléfono|llame|llamar",
}
AGAINST = "version|isbn|order|invoice|chapter|section|page|figure|nr|no|token|id|bestellung|rechnung|seite|facture|pedido|kapitel"
LABELERS = ("format", "gazetteer", "context", "check", "against")
#: Code points before a span in which context words count.
BEFORE = 40
#: Code points of the pieces that a text is rewritten from.
PIECE = 256
ITERATIONS, STEPS, RATE, THRESHOLD = 30, 300, 0.5, 0.5

_SPAN = "struct<kind:int,start:int,stop:int,base:boolean,format:int,gazetteer:int,context:int,check:int,against:int>"


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(xs: Column, of, join, zero: Column) -> Column:
    """For each element of xs what join makes of of(x) of all elements before it, from zero on; join must be associative.

    An array can only grow by being copied, so elements go in about sqrt(n) chunks: their totals come first, then each chunk is
    scanned from its own beginning. n elements take n * sqrt(n) copied references, and each string is read a fixed number of times.
    """

    def run(values: Column, begin: Column, value) -> Column:
        empty = F.slice(F.array(zero), 1, 0)
        step = lambda acc, x: F.struct(join(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, F.struct(begin.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def scanned(xs: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(xs) + size - 1) / size).cast("int") - 1), lambda i: F.slice(xs, i * size + 1, size))

        def whole(chunks: Column) -> Column:
            totals = F.transform(chunks, lambda chunk: F.aggregate(chunk, zero, lambda acc, x: join(acc, of(x))))
            return F.flatten(F.zip_with(chunks, run(totals, zero, lambda x: x), lambda chunk, begin: run(chunk, begin, of)))

        return F.when(F.size(xs) == 0, F.slice(F.array(zero), 1, 0)).otherwise(_let(chunks, whole))

    return _let(xs, scanned)


def _tail(x: Column) -> Column:
    return F.right(x, F.lit(BEFORE))


def _spans(text: Column, pattern: str) -> Column:
    """(start, stop, what, near) of the leftmost non-overlapping matches, in code points; near: the BEFORE before a match.

    Places are lengths of matches and of the parts between them added up, and near is cut from those parts, so no match needs the text again.
    """
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(found: Column) -> Column:
        cut = F.transform(F.arrays_zip(found.alias("what"), F.slice(parts, 1, F.size(found)).alias("gap")), lambda x: F.struct(x["what"].alias("what"), F.length(x["gap"]).alias("gap"), _tail(x["gap"]).alias("last")))
        of = lambda x: F.struct((x["gap"] + F.length(x["what"])).alias("at"), _tail(F.concat(x["last"], x["what"])).alias("tail"))
        join = lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), _tail(F.concat(a["tail"], b["tail"])).alias("tail"))

        def spans(cut: Column) -> Column:
            before = _scan(cut, of, join, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")))

            def one(x: Column, b: Column) -> Column:
                start = b["at"] + x["gap"]
                return F.struct(start.alias("start"), (start + F.length(x["what"])).alias("stop"), x["what"].alias("what"), _tail(F.concat(b["tail"], x["last"])).alias("near"))

            return F.zip_with(cut, before, one)

        return _let(cut, spans)

    none = F.array().cast("array<struct<start:int,stop:int,what:string,near:string>>")
    return _let(found, lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of x pass Luhn's check."""
    return F.call_function("luhn_check", _digits(x))


def _octets(x: Column) -> Column:
    """Whether all numbers in x are at most 255: leading zeros off, compared by length and then as numbers."""
    numbers = F.transform(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))
    return F.forall(numbers, lambda n: (F.length(n) < 3) | (F.length(n) == 3) & (n <= "255"))


def valid(kind: str, x: Column) -> Column:
    """The base rules on what a pattern matched."""
    n = F.length(_digits(x))
    return {"email": F.lit(True), "ip": _octets(x), "card": n.between(16, 19) & _luhn(x), "phone": n.between(8, 15)}[kind]


def _passes(kind: str):
    return lambda s: valid(kind, s["what"])


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.when(no, F.lit(-1)) if no is not None else out).otherwise(F.lit(0))


def _votes(kind: str, s: Column) -> list[Column]:
    """One vote a labeler: 1 for personal data, -1 against, 0 for neither."""
    x, digits = s["what"], _digits(s["what"])
    near = F.lower(s["near"])
    gazetteer = {
        "email": _vote(F.lower(F.regexp_extract(x, r"([A-Za-z0-9]+)$", 1)).isin(HOST_ENDS)),
        "ip": _vote(~F.regexp_extract(x, "^0*([0-9]+)", 1).isin("0", "255"), F.regexp_extract(x, "^0*([0-9]+)", 1).isin("0", "255")),
        "card": _vote(F.substring(digits, 1, 1).isin("2", "3", "4", "5", "6")),
        "phone": _vote(x.startswith("+") | x.startswith("00") | x.contains("("), digits.rlike("^0{4}|^1{6}")),
    }[kind]
    form = {
        "email": _vote(x.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$") | x.rlike(r"[\[({](?i:at)[\])}]"), x.rlike(r"\sat\s")),
        "ip": _vote(x.rlike(r"^[0-9]+(\.[0-9]+){3}$") | x.rlike(r"[\[(]")),
        "card": _vote(F.length(digits).between(16, 19), ~F.length(digits).between(13, 19)),
        "phone": _vote(F.length(digits).between(9, 15), ~F.length(digits).between(8, 15)),
    }[kind]
    check = {
        "email": _vote(~x.contains("..") & ~x.startswith("."), x.contains("..") | x.startswith(".")),
        "ip": _vote(_octets(x), ~_octets(x)),
        "card": _vote(_luhn(x), ~_luhn(x)),
        "phone": _vote(digits.rlike("([0-9])(?!\\1)"), digits.rlike("^([0-9])\\1+$")),
    }[kind]
    return [form, gazetteer, _vote(near.rlike(rf"(?<!\p{{L}})(?:{CONTEXT[kind]})(?!\p{{L}})")), check, _vote(F.lit(False), near.rlike(rf"(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})[^\p{{L}}]*$"))]


def _labelled(kind: str, spans: Column, base: bool) -> Column:
    def made(s: Column) -> Column:
        votes = [v.cast("int").alias(n) for n, v in zip(LABELERS, _votes(kind, s), strict=True)]
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(base).alias("base"), *votes)

    return F.transform(spans, made)


def candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out_col: str = "spans") -> DataFrame:
    """keep's columns and out_col: base spans and wider candidates with their votes, one array a row, without a shuffle."""
    keep = docs.columns if keep is None else keep
    t = F.col("__text")
    out = docs.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    none = F.array().cast(f"array<{_SPAN}>")
    digit = t.rlike("[0-9]")
    made = []
    for kind in KINDS:
        hint = F.lit(True) if not NEEDS[kind] else F.contains(t, F.lit(NEEDS[kind]))
        base = F.filter(_spans(t, BASE[kind]), _passes(kind))
        wide = _spans(t, WIDE[kind])
        wide_hint = {"email": F.contains(t, F.lit("@")) | t.rlike(r"(?i)[\[({]at[\])}]|\sat\s[^\n]{1,80}?\sdot\s"), "ip": digit & t.rlike(r"[0-9]\s?[\[(]")}.get(kind, digit)
        made.append(F.when(hint & (digit if kind != "email" else F.lit(True)), _labelled(kind, base, True)).otherwise(none))
        made.append(F.when(wide_hint, _labelled(kind, wide, False)).otherwise(none))
    out = out.select(*[F.col(f"`{k}`") for k in keep], F.concat(*made).alias("__all"))
    return out.select(*[F.col(f"`{k}`") for k in keep], _free(F.col("__all")).alias(out_col))


def _free(spans: Column) -> Column:
    """spans without wider candidates that overlap a base span of any kind: those are that span.

    In order of start, base spans first: the greatest end of base spans before a candidate, and the least start of those
    behind it, tell.
    """
    order = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (~s["base"]).alias("wide"), s.alias("span")))), lambda x: x["span"])
    far = F.lit(2**31 - 1)

    def kept(xs: Column) -> Column:
        ends = _scan(xs, lambda s: F.when(s["base"], s["stop"]).otherwise(F.lit(-1)), F.greatest, F.lit(-1))
        starts = F.reverse(_scan(F.reverse(xs), lambda s: F.when(s["base"], s["start"]).otherwise(far), F.least, far))
        both = F.arrays_zip(xs.alias("s"), ends.alias("end"), starts.alias("begin"))
        return F.transform(F.filter(both, lambda x: x["s"]["base"] | (x["end"] <= x["s"]["start"]) & (x["begin"] >= x["s"]["stop"])), lambda x: x["s"])

    mixed = F.exists(spans, lambda s: s["base"]) & F.exists(spans, lambda s: ~s["base"])
    return F.when(mixed, _let(order, kept)).otherwise(spans)


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], iterations: int = ITERATIONS) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of each (kind, votes), by expectation-maximisation over pattern counts: a naive Bayes model with two classes.

    A kind's patterns share their prior; each labeler has for each class and vote a probability. Begins from the majority.
    """
    post = {(k, v): 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for k, v, _ in patterns}
    for _ in range(iterations):
        prior: dict[tuple[int, int], float] = {}
        rate: dict[tuple[int, int, int, int], float] = {}
        for k, votes, n in patterns:
            for y, p in ((1, post[k, votes]), (0, 1 - post[k, votes])):
                prior[k, y] = prior.get((k, y), 1.0) + n * p
                for j, v in enumerate(votes):
                    rate[k, j, v, y] = rate.get((k, j, v, y), 0.0) + n * p
        for k, votes, _ in patterns:
            log = []
            for y in (1, 0):
                total = prior[k, y]
                # smoothed towards labelers that are right rather than wrong
                log.append(math.log(total) + sum(math.log((rate.get((k, j, v, y), 0.0) + (2.0 if v == 2 * y - 1 else 1.0)) / (total + 4.0)) for j, v in enumerate(votes)))
            post[k, votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, log[1] - log[0]))))
    return post


def train(patterns: list[tuple[int, tuple[int, ...], int]], post: dict, steps: int = STEPS, rate: float = RATE) -> list[list[float]]:
    """Span classifier: for each kind a logistic regression on votes (two inputs a labeler and a constant), to soft labels."""
    width = 2 * len(LABELERS) + 1
    out = [[0.0] * width for _ in KINDS]
    for k in range(len(KINDS)):
        mine = [(v, n, post[k, v]) for kk, v, n in patterns if kk == k]
        total = sum(n for _, n, _ in mine)
        for _ in range(steps if total else 0):
            grad = [0.0] * width
            for v, n, p in mine:
                x = [float(u == s) for u in v for s in (1, -1)] + [1.0]
                z = sum(a * b for a, b in zip(out[k], x, strict=True))
                d = n / total * (p - 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
                grad = [g + d * b for g, b in zip(grad, x, strict=True)]
            out[k] = [w + rate * (g - 0.001 * w) for w, g in zip(out[k], grad, strict=True)]
    return out


def fit(found: DataFrame, spans: str = "spans") -> list[list[float]]:
    """The classifier's weights from all candidates' vote patterns."""
    one = found.select(F.explode(spans).alias("s"))
    rows = one.groupBy("s.kind", *[f"s.{n}" for n in LABELERS]).count().collect()
    patterns = sorted((r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in rows)
    return train(patterns, estimate(patterns))


def _chosen(weights: list[list[float]], threshold: float, spans: str = "spans") -> Column:
    """Base spans, and candidates that the classifier takes, by kind and start."""

    def score(s: Column) -> Column:
        total = F.lit(0.0)
        for k, w in enumerate(weights):
            z = F.lit(w[-1])
            for j, n in enumerate(LABELERS):
                z = z + F.when(s[n] == 1, F.lit(w[2 * j])).when(s[n] == -1, F.lit(w[2 * j + 1])).otherwise(F.lit(0.0))
            total = F.when(s["kind"] == k, z).otherwise(total)
        return total

    taken = F.filter(spans, lambda s: s["base"] | (score(s) > math.log(threshold / (1 - threshold))))
    return F.array_sort(taken)


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """keep's columns and spans: an array of (kind, start, stop, base, votes) in code points, stop exclusive, by kind and start.

    Null texts are empty. All base spans stay; candidates are added where the classifier, fitted to all candidates of
    the table, takes them. Long texts are searched whole, in
    time linear in the text and of about n * sqrt(n) copied references in its n matches; repeated rows are searched one by one. A kept
    column named spans gives way. An empty table stays empty.
    """
    keep = [k for k in (docs.columns if keep is None else keep) if k != "spans"]
    found = durable(candidates(docs, text, keep))
    return found.withColumn("spans", _chosen(fit(found), threshold))


def _written(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _base_of(kind: int):
    return lambda s: s["base"] & (s["kind"] == kind)


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _base_of(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return found.select(*[F.col(f"`{k}`") for k in keep], *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span in text replaced by [KIND]; overlapping spans are one, named by the first. Null texts stay null.
    Long texts take time as in find.

    Candidates are taken twice, for the fit and for the texts, so that no text is kept in between.
    """
    columns = docs.columns
    weights = fit(candidates(docs, text, []))
    found = candidates(docs, text, columns, "__spans").withColumn("__spans", _chosen(weights, threshold, "__spans"))
    order = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    t = F.col(f"`{text}`")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    blocks = F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def written(blocks: Column) -> Column:
        """The text in blocks, from which a part is cut without reading it from its beginning."""

        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            mine = F.array_join(F.slice(blocks, first + 1, F.greatest(F.lit(0), F.floor((b - 1) / PIECE).cast("int") - first + 1)), "")
            return F.when(b > a, F.substring(mine, a - first * PIECE + 1, b - a)).otherwise(F.lit(""))

        def tagged(xs: Column) -> Column:
            ends = _scan(xs, lambda s: s["stop"], F.greatest, F.lit(0))
            # a span that begins behind all ends before it begins a new tag; those ends are where the text between begins
            heads = F.filter(F.arrays_zip(xs.alias("s"), ends.alias("end")), lambda x: x["s"]["start"] >= x["end"])
            body = F.transform(heads, lambda x: F.concat(part(x["end"], x["s"]["start"]), F.element_at(tags, x["s"]["kind"] + 1)))
            return F.concat(F.array_join(body, ""), part(F.array_max(F.transform(xs, lambda s: s["stop"])), F.length(t)))

        return _let(order, tagged)

    new = F.when(t.isNull() | (F.size("__spans") == 0), t).otherwise(_let(blocks, written))
    return found.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in columns])


def op5(spark, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents"), keep=["doc_id"]), ["doc_id"])
