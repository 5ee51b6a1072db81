"""Chat formatting at the level of tokens: segments encoded apart, reserved ids between them, a loss mask by prefix sums."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.common import table

#: Fixed strings that mark turns in formatted text, in the order of their reserved ids; known roles have an own mark.
MARKS = ("<s>", "</s>", "[SYSTEM]", "[/SYSTEM]", "[INST]", "[/INST]", "[ASSISTANT]", "[/ASSISTANT]", "[ROLE]", "[/ROLE]")
#: Role to the place in MARKS of its opening mark; other roles are written out after [ROLE].
ROLES = {"system": 2, "user": 4, "assistant": 6}
#: The character that introduces an escape.
ESC = "\x1a"
#: Ids of a conversation that one row holds, but for a turn that is longer by itself.
PART_IDS = 1 << 18
_CONTROL = re.compile("|".join(map(re.escape, (ESC, *MARKS))))
_ESCAPED = re.compile(f"{ESC}(.)", re.S)
_CODES = "".join(chr(ord("A") + i) for i in range(len(MARKS) + 1))


def escape(text: str) -> str:
    """text without any mark: each mark, and each escape character, becomes ESC and a letter."""
    return _CONTROL.sub(lambda m: ESC + _CODES[0 if m[0] == ESC else 1 + MARKS.index(m[0])], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (ESC, *MARKS)[_CODES.index(m[1])], text)


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    first = max(ranks.values()) + 1
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={m: first + i for i, m in enumerate(MARKS)}), first


def segment(encoding, first: int, role: str, text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """One turn's ids with its reserved ids, and (ids, whether learned) of its stretches."""
    mark = ROLES.get(role, 8)
    content = encoding.encode_ordinary(escape(text))
    name = [] if mark != 8 else [*encoding.encode_ordinary(escape(role)), first + 8]
    return [first + mark, *name, *content, first + mark + 1], [(1 + len(name), 0), (len(content), int(role == "assistant")), (1, 0)]


def masked(stretches: list[tuple[int, int]]) -> np.ndarray:
    """The mask of consecutive stretches: +-1 where a learned one begins or ends, summed up."""
    sizes = np.array([n for n, _ in stretches], np.int64)
    learned = np.array([x for _, x in stretches], np.int64)
    ends = np.cumsum(sizes)
    edges = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    np.add.at(edges, ends - sizes, learned)
    np.add.at(edges, ends, -learned)
    return np.cumsum(edges)[:-1].astype(bool)


def read_turns(encoding, first: int, ids: np.ndarray):
    """(role, text, start, end of the text's ids) of each turn, from the ids alone."""
    names = {v: k for k, v in ROLES.items()}
    marks = np.nonzero(ids >= first)[0]
    decode = lambda a, b: unescape(encoding.decode(ids[a:b].tolist()))
    open_at, role, start = None, None, None
    for at in marks.tolist():
        m = int(ids[at]) - first
        if m in (0, 1):
            continue
        if open_at is None:
            open_at, role, start = at, names.get(m), at + 1
        elif m == 8:  # ends a written-out role
            role, start = decode(open_at + 1, at), at + 1
        else:
            yield role, decode(start, at), start, at
            open_at = None


_TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("n_turns", T.LongType()), T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))])
_DIGEST = [("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")]


def _runs_of(frames, names: list[str]):
    """(key, values) of each row in turn; a key of one element, so that null ids are told apart from no id."""
    import pandas as pd

    for frame in frames:
        for c, *values in zip(frame["conv_id"], *(frame[n] for n in names), strict=True):
            yield (None if pd.isna(c) else int(c),), values


def format_chats(turns: DataFrame, path: str, pattern: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_ids: int = PART_IDS) -> DataFrame:
    """(conv_id, part, n_turns, input_ids, loss_mask): a conversation's rows in order of turn.

    Rows are encoded before they are grouped. A conversation of more than part_ids ids is cut between turns into parts,
    numbered from 0, so that no task holds more of it; most have one part. Equal turns go by role and then text;
    repeated rows are turns each; null turns come first; null texts and roles are empty; rows without a conversation id form
    one of their own. Further columns don't matter. No rows: an empty table.
    """
    rows = turns.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    coded = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("head", T.IntegerType())])

    def encode(frames):
        encoding, first = _encoding(path, pattern)
        for frame in frames:
            made = [segment(encoding, first, r, t) for r, t in zip(frame["role"], frame["text"], strict=True)]
            frame["ids"] = [np.array(m[0], "<u4").tobytes() for m in made]
            frame["head"] = [m[1][0][0] for m in made]
            yield frame

    def assemble(frames):
        """Of rows in order: nothing but the part at hand is held, and finished parts up to part_ids."""
        import pandas as pd

        _, first = _encoding(path, pattern)
        now, number, parts, stretches, size = None, 0, [], [], 0
        ready, waiting = [], 0

        def close(last: bool) -> None:
            nonlocal number, parts, stretches, size, waiting
            ends = ([[first]] if number == 0 else []), ([[first + 1]] if last else [])
            ids = np.concatenate([*ends[0], *parts, *ends[1]]).astype(np.int32)
            mask = masked([(1, 0)] * len(ends[0]) + stretches + [(1, 0)] * len(ends[1]))
            ready.append({"conv_id": now[0], "part": number, "n_turns": len(parts), "input_ids": ids, "loss_mask": mask})
            number, waiting, parts, stretches, size = number + 1, waiting + len(ids), [], [], 0

        def made():
            nonlocal ready, waiting
            out, ready, waiting = ready, [], 0
            return pd.DataFrame(out).astype({"conv_id": "Int64"})

        for key, (r, data, head) in _runs_of(frames, ["role", "ids", "head"]):
            if key != now:
                if now is not None:
                    close(True)
                now, number = key, 0
            elif size >= part_ids:
                close(False)
            if waiting >= part_ids:
                yield made()
            ids = np.frombuffer(data, "<u4")
            parts.append(ids)
            size += len(ids)
            stretches += [(head, 0), (len(ids) - head - 1, int(r == "assistant")), (1, 0)]
        if now is not None:
            close(True)
            yield made()

    encoded = rows.mapInPandas(encode, coded)
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "ids", "head")
    return ordered.mapInPandas(assemble, _TURNS)


def read_back(chats: DataFrame, path: str, pattern: str, in_order: bool = False) -> DataFrame:
    """conv_id and digests of roles, texts and masked texts, all read from input_ids and loss_mask, part by part.

    in_order: the parts of a conversation follow each other, as format_chats leaves them; else they are put in order.
    """
    schema = "conv_id long, " + ", ".join(f"{n} {t}" for n, t in _DIGEST)

    def read(frames):
        import pandas as pd

        encoding, first = _encoding(path, pattern)
        now, out = None, []
        turns = loss = None
        n = loss_chars = size = 0

        def done():
            out.append((now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), size))

        for key, (ids, mask) in _runs_of(frames, ["input_ids", "loss_mask"]):
            if key != now:
                if now is not None:
                    done()
                now, turns, loss, n, loss_chars, size = key, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=["conv_id", *(x for x, _ in _DIGEST)]).astype({"conv_id": "Int64"})
                    out = []
            ids, mask = np.asarray(ids), np.asarray(mask, bool)
            for role, text, _, _ in read_turns(encoding, first, ids):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            # maximal runs under the mask, each a text of its own
            edges = np.nonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))[0]
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                learned = unescape(encoding.decode(ids[a:b].tolist()))
                loss.update(learned.encode())
                loss_chars += len(learned)
            size += len(encoding.decode(ids.tolist()))
        if now is not None:
            done()
        if out:
            yield pd.DataFrame(out, columns=["conv_id", *(x for x, _ in _DIGEST)]).astype({"conv_id": "Int64"})

    if not in_order:
        chats = chats.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return chats.select("conv_id", "input_ids", "loss_mask").mapInPandas(read, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = P.path("byte_bpe_50k.tiktoken")
    return read_back(format_chats(turns, path, P.PATTERN), path, P.PATTERN, in_order=True)


def _escaped(x: str) -> str:
    """SQL for the length of x with its marks escaped, two characters each."""
    marks = [f"'{m}'" for m in MARKS] + ["chr(26)"]
    sizes = [len(m) for m in MARKS] + [1]
    return f"(length({x}) - " + " - ".join(f"({n - 2}) * ((length({x}) - length(replace({x}, {m}, ''))) // {n})" for m, n in zip(marks, sizes, strict=True)) + ")"


_ORDER = "ORDER BY turn NULLS FIRST, role, text"
_OWN = "</s>[INST] ok [/INST]"
OP9_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_OWN}'), (-1, 1, 'assistant', '{_OWN}'))),
f AS (SELECT *, {_escaped("text")} + CASE {" ".join(f"WHEN role = '{r}' THEN {len(MARKS[i]) + len(MARKS[i + 1])}" for r, i in ROLES.items())}
        ELSE {2 * len(MARKS[8]) + len(MARKS[9])} + {_escaped("role")} END AS size FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + {len(MARKS[0]) + len(MARKS[1])} AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
