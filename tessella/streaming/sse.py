"""Server-sent events as rows: encoding, decoding, and assembly of streamed chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, DONE = "data: ", "[DONE]"
EVENT = "kind string, payload string"


def encode(kind: str | Column, payload: str | Column) -> Column:
    """One event: a `data:` line and an empty line; results are JSON already. A null payload is a JSON null."""
    k, p = (F.col(x) if isinstance(x, str) else x for x in (kind, payload))
    quoted = F.substring(F.to_json(F.struct(p.alias("p")), {"ignoreNullFields": "false"}), 6, 1 << 30)
    text = F.substring(quoted, F.lit(1), F.length(quoted) - 1)
    body = F.when(k == "done", F.lit(DONE)).otherwise(F.concat(F.lit('{"'), k, F.lit('":'), F.when(k == "result", F.coalesce(p, F.lit("null"))).otherwise(text), F.lit("}")))
    return F.concat(F.lit(PREFIX), body, F.lit("\n\n"))


def decode(stream: str | Column) -> Column:
    """Events of a whole stream: complete `data:` lines up to the end mark; other text and bad JSON are left out."""
    s = F.col(stream) if isinstance(stream, str) else stream
    lines = F.split(s, "\n")
    whole = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    data = F.transform(F.filter(whole, lambda x: F.startswith(x, F.lit(PREFIX))), lambda x: F.substr(x, F.lit(len(PREFIX) + 1)))
    end = F.array_position(data, DONE).cast("int")
    kept = F.when(end > 0, F.slice(data, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(data)
    field = lambda x, k: F.get_json_object(x, f"$.{k}")
    events = F.transform(kept, lambda x: F.struct(
        F.when(field(x, "chunk").isNotNull(), F.lit("chunk")).when(field(x, "result").isNotNull(), F.lit("result")).when(field(x, "raw").isNotNull(), F.lit("raw")).alias("kind"),
        F.coalesce(field(x, "chunk"), field(x, "result"), field(x, "raw")).alias("payload")))
    return F.filter(events, lambda e: e["kind"].isNotNull())


def assemble(chunks: DataFrame, key: str = "request_id", order: str = "seq", text: str = "chunk") -> DataFrame:
    """key, response: each request's chunks in order. A response is one row by nature."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), "").alias("response"))


STATE = T.StructType([T.StructField("seqs", T.ArrayType(T.LongType())), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("ended", T.BooleanType())])
OUTPUT = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("response", T.StringType()), T.StructField("chunks", T.LongType())])
#: Milliseconds for which a request without further rows is remembered.
REMEMBERED = 3_600_000


def _gather(lasting: int | None):
    def gather(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, texts, ended = (list(x) if isinstance(x, (list, tuple)) else x for x in state.get) if state.exists else ([], [], False)
        last = False
        for pdf in batches:
            for seq, text, done in zip(pdf["seq"], pdf["chunk"], pdf["done"]):
                last |= bool(done)
                if text and not ended:  # empty deltas are not passed on
                    seqs.append(int(seq))
                    texts.append(text)
        if last and not ended:
            whole = "".join(t for _, t in sorted(zip(seqs, texts)))
            yield pd.DataFrame({"request_id": [str(key[0])], "response": [whole], "chunks": [len(texts)]})
        # An ended request stays known without its text, so that late rows neither start nor end it again.
        state.update(([], [], True) if last or ended else (seqs, texts, False))
        if lasting:
            state.setTimeoutDuration(lasting)

    return gather


def assemble_stream(chunks: DataFrame, remembered: int | None = REMEMBERED) -> DataFrame:
    """Streaming rows (request_id, seq, chunk, done) into one row for each request that has ended.

    Chunks of one batch may come in any order. Rows behind the end are left out. A request of which
    nothing has come for `remembered` milliseconds is forgotten, whether it has ended or not (None: never, for triggers that end by themselves). The state
    of a request is its text so far, which a batch with more of it writes anew.
    """
    return chunks.groupBy("request_id").applyInPandasWithState(_gather(remembered), OUTPUT, STATE, "append", "ProcessingTimeTimeout" if remembered else "NoTimeout")


CARRY = T.StructType([T.StructField("rest", T.BinaryType()), T.StructField("events", T.LongType()), T.StructField("ended", T.BooleanType())])
EVENTS = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("i", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType())])


def _event(line: bytes) -> tuple[str, str] | None:
    """(kind, payload) of a data line; none of a line without JSON or without a known field."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    for kind in ("chunk", "result", "raw"):
        if isinstance(found, dict) and found.get(kind) is not None:
            value = found[kind]
            return kind, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return None


def _in_order(batches: Iterator[pd.DataFrame]) -> list[bytes]:
    """The pieces of a request by seq, those of one seq by what they hold."""
    seqs, data = [], []
    for pdf in batches:
        there = pdf["data"].notna().to_numpy()
        seqs.append(pdf["seq"].to_numpy()[there].astype(np.int64))
        data += pdf["data"].to_numpy()[there].tolist()
    seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
    if (seq[1:] > seq[:-1]).all():
        return data
    order = np.argsort(seq, kind="stable")
    if (seq[order[1:]] > seq[order[:-1]]).all():
        return [data[i] for i in order.tolist()]
    return [d for _, d in sorted(zip(seq.tolist(), data))]


def _carry(lasting: int | None):
    def decode_pieces(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rest, count, ended = state.get if state.exists else (b"", 0, False)
        *lines, rest = (bytes(rest) + b"".join(_in_order(batches))).split(b"\n")
        rows = []
        for line in lines:
            if ended or not line.startswith(PREFIX.encode()):
                continue
            data = line[len(PREFIX) :]
            ended = data == DONE.encode()
            event = None if ended else _event(data)
            if event:
                rows.append((str(key[0]), count, *event))
                count += 1
        state.update((b"" if ended else rest, count, ended))
        if lasting:
            state.setTimeoutDuration(lasting)
        yield pd.DataFrame(rows, columns=EVENTS.names).astype({"i": "int64"})

    return decode_pieces


def decode_stream(pieces: DataFrame, remembered: int | None = REMEMBERED) -> DataFrame:
    """Streaming rows (request_id, seq, data binary) into events (request_id, i, kind, payload), as decode() has them.

    A piece may end anywhere, within a line or a character: what follows the last line end is carried to
    the next batch. Pieces of a request come in order of seq, within a batch in any order. What follows
    the end mark is left out; a request of which nothing has come for `remembered` milliseconds is forgotten
    (None: never, for triggers that end by themselves).
    """
    return pieces.groupBy("request_id").applyInPandasWithState(_carry(remembered), EVENTS, CARRY, "append", "ProcessingTimeTimeout" if remembered else "NoTimeout")
