"""Chat formatting by token-level assembly.

Every segment of a turn (role, text) is encoded on its own and joined by reserved ids beyond the vocabulary, so no text can
make a control token.  Where the template's control strings occur inside a text they get a backslash, which reading
back takes away again.  The loss mask of a part is the prefix sum of +1 where a trained text begins and -1 where it ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, compiled, default_path, vocabulary
from .common import table


@dataclass(frozen=True)
class Template:
    """Markers of a turn, in the order of their reserved ids, further control strings to escape, and the trained roles."""

    begin: str = "<turn>"
    body: str = "<body>"
    end: str = "</turn>"
    controls: tuple[str, ...] = ("### System:", "### User:", "### Assistant:", "### Tool:")
    trained: tuple[str, ...] = ("assistant",)
    pattern: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        words = "|".join(map(re.escape, (self.begin, self.body, self.end, *self.controls)))
        object.__setattr__(self, "pattern", re.compile(rf"\\*(?:{words})"))

    def escape(self, text: str) -> str:
        """One more backslash before every control string, however many there are."""
        return self.pattern.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self.pattern.sub(lambda m: m[0][1:], text)


#: Tokens of a part: a longer conversation is put out in several parts, so no row grows with its number of turns.
PART_TOKENS = 1 << 20


def encode_turns(rows: DataFrame, tokenizer: str, template: Template, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, ids): each turn's tokens with reserved ids; row by row, before anything is grouped."""
    source = rows.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(source.value)
        begin, body, end = (np.array([len(bpe.labels) + i], "<u4").tobytes() for i in range(3))
        for b in batches:
            roles, texts = ([template.escape(x) for x in b.column(c).to_pylist()] for c in ("role", "text"))
            out = [b"".join((begin, r.tobytes(), body, t.tobytes(), end)) for r, t in zip(bpe.encode_all(roles, False), bpe.encode_all(texts, False), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], ["conv_id", "turn", "role", "text", "ids"])

    kinds = [rows.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]
    plain = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return plain.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, role string, text string, ids binary")


def format_conversations(
    rows: DataFrame,
    tokenizer: str,
    template: Template | None = None,
    part_tokens: int = PART_TOKENS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, part, n_turns, ids array<int>, loss_mask array<tinyint>), in order within each partition.

    Turns are ordered by turn, then role, then text (null turns first); null roles and texts are empty; rows with a null
    conv_id are one conversation.  Repeated rows are turns of their own.  A conversation is one part (0) unless it has more
    than ``part_tokens`` tokens; parts end between turns.  Extra columns are ignored; an empty table gives no rows.
    Turns stream through their task in order: memory is bounded by a part, and the costly encoding is done before.
    """
    template = template or Template()
    source = rows.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    turns = encode_turns(rows, tokenizer, template, conv_col, turn_col, role_col, text_col)
    ordered = turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "ids")
    trained = set(template.trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(compiled(source.value).labels)
        body = size + 1

        def put(kind: pa.DataType, out: list[tuple]) -> pa.RecordBatch:
            conv, part, n, ids, masks = [], [], [], [], []
            for c, k, roles, segments in out:
                own = np.frombuffer(b"".join(segments), "<u4")
                delta = np.zeros(len(own) + 1, np.int8)
                at = 0
                for role, segment in zip(roles, segments, strict=True):
                    if role in trained:
                        s = np.frombuffer(segment, "<u4")
                        delta[at + int(np.flatnonzero(s == body)[0]) + 1] += 1
                        delta[at + len(s) - 1] -= 1
                    at += len(segment) // 4
                conv.append(c), part.append(k), n.append(len(roles)), ids.append(own.view("<i4")), masks.append(np.cumsum(delta[:-1], dtype=np.int8))
            return pa.RecordBatch.from_arrays(
                [pa.array(conv, kind), pa.array(part, pa.int32()), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))],
                ["conv_id", "part", "n_turns", "ids", "loss_mask"],
            )

        done, held, current, part, roles, segments, tokens = [], 0, object(), 0, [], [], 0
        kind = None
        for b in batches:
            kind = b.column("conv_id").type
            for c, role, ids in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if segments and (c != current or tokens + len(ids) // 4 > part_tokens):
                    done.append((current, part, roles, segments))
                    held += tokens
                    part = part + 1 if c == current else 0
                    roles, segments, tokens = [], [], 0
                    if held > part_tokens:
                        yield put(kind, done)
                        done, held = [], 0
                elif c != current:
                    part = 0
                current = c
                roles.append(role), segments.append(ids)
                tokens += len(ids) // 4
        if segments:
            done.append((current, part, roles, segments))
        if done:
            yield put(kind, done)

    conv = rows.schema[conv_col].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {conv}, part int, n_turns long, ids array<int>, loss_mask array<tinyint>")


def read_turns(bpe: ByteBpe, template: Template, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the mask, formatted characters) of each turn of a part, read from its tokens."""
    size = len(bpe.labels)
    text = lambda part: template.unescape(bpe.decode(part).decode("utf-8", "replace"))
    for a, b, c in np.flatnonzero(ids >= size).reshape(-1, 3):
        own = ids[b + 1 : c]
        loss = own[mask[b + 1 : c].astype(bool)]
        n = sum(len(bpe.decode(ids[i + 1 : j]).decode("utf-8", "replace")) for i, j in ((a, b), (b, c)))
        yield text(ids[a + 1 : b]), text(own), text(loss), n + len(template.begin) + len(template.body) + len(template.end)


def digest_conversations(formatted: DataFrame, tokenizer: str, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted parts in order."""
    template = template or Template()
    source = formatted.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(source.value)
        state: list | None = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def put(kind: pa.DataType, rows: list[list]) -> pa.RecordBatch:
            rows = [[c, n, h.hexdigest(), k, loss.hexdigest(), f] for c, n, h, k, loss, f in rows]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        kind = None
        for b in batches:
            kind, out = b.column("conv_id").type, []
            for c, part, ids, mask in zip(b.column("conv_id").to_pylist(), b.column("part").to_pylist(), b.column("ids"), b.column("loss_mask"), strict=True):
                if part == 0:
                    out += [state] if state else []
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, loss, n in read_turns(bpe, template, ids.values.to_numpy(), mask.values.to_numpy()):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                    state[5] += n
            if out:
                yield put(kind, out)
        if state:
            yield put(kind, [state])

    conv = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "part", "ids", "loss_mask").mapInArrow(run, schema)


def op3_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    path = default_path("byte_bpe_50k.json")
    return digest_conversations(format_conversations(rows.unionByName(extra), path), path)


OP3_SQL = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), t AS (
  SELECT *, regexp_replace(text, '(<turn>|<body>|</turn>|### System:|### User:|### Assistant:|### Tool:)', '_\\1', 'g') AS escaped,
         regexp_replace(coalesce(role, ''), '(<turn>|<body>|</turn>|### System:|### User:|### Assistant:|### Tool:)', '_\\1', 'g') AS who
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + length(who) + 19) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
