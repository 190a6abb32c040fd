"""Chat formatting in budgeted windows.

The turns of a conversation, in order, are dealt to windows of at most `budget` tokens, in aligned
spans of whole turns: prefix sums of the turns' tokens tell how many still fit. Every window after the
first begins with context: the system turn, if the conversation opens with one, and as many of the
last turns before it as `history` tokens hold. The loss mask covers the text of assistant turns where
they appear first; what is repeated is masked out, so that each target counts once.

No window exceeds the budget. History gives way first; a system turn of more than a quarter of the
budget is repeated only by its beginning of that size; a turn of more than the other three quarters
is cut into parts, whose masks join up. Only a role so long that it alone exceeds that makes a window
larger: roles aren't cut. Tokens are those of each rendered turn or part by itself.

    ### role ###
    text</turn>

In role and text, `#`, `<` and the backslash are written with a backslash before them, so that an
unescaped one is always the template's own; `parse` undoes it. A part that the next one continues ends
in `</part>`.

Turns are rendered and counted before any shuffle, then sorted over all tasks. Sums of each task's
rows make the prefix sums, and these cut conversations into sections of SECTION windows, each formatted
by itself with its own copy of the context before it: a conversation with a third of all turns is
spread over as many tasks as its length takes. Reading back hashes a conversation in order, so it
streams through one task.

Null texts and roles count as empty; turns with equal numbers go by role, then by the md5 of the
text, null numbers first; rows that repeat are turns of their own; null conv_ids are one conversation;
an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import load_encoding
from .common import annotate, save

#: Windows' worth of tokens after which a conversation is cut.
SECTION = 64

_CONTROL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\#<]+|\\.)*) ###\n((?:[^\\#<]+|\\.)*)</(turn|part)>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str, end: str = "turn") -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends there."""
    head, body = f"### {escape(role)} ###\n", escape(text)
    return f"{head}{body}</{end}>\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str, bool]]:
    """The (role, text, whether the turn ends here) of a formatted window's turns and parts."""
    return [(unescape(a), unescape(b), c == "turn") for a, b, c in _TURN.findall(text)]


def cut(role: str, text: str, limit: int, count) -> list[tuple[str, int, int, int]]:
    """(formatted, text's begin, text's end, tokens) of a turn, in parts if it has more than `limit` tokens."""
    whole = render(role, text)
    n = count(whole[0])
    if n <= limit:
        return [(*whole, n)]
    out, at, guess = [], 0, max(1, len(text) * limit // n)
    while at < len(text) or not out:
        size = min(guess, len(text) - at)
        while True:
            part = render(role, text[at:at + size], "turn" if at + size == len(text) else "part")
            n = count(part[0])
            if n <= limit or size <= 1:
                break
            size = max(1, min(size - 1, size * limit // n))
        out.append((*part, n))
        at += size
    return out


def _parts(path: str, pattern: str, budget: int):
    def start():
        import pyarrow as pa

        enc = load_encoding(path, pattern)

        def count(text: str) -> int:
            return len(enc.encode_ordinary(text))

        def parts(texts):
            rows = []
            for i, packed in enumerate(texts):
                size, rest = packed.split(":", 1)
                role, text = rest[:int(size)], rest[int(size):]
                short = cut(role, text, budget // 4, count)[0] if role == "system" else (None, 0, 0, 0)
                for k, part in enumerate(cut(role, text, budget - budget // 4, count)):
                    rows.append((i, k, *part, short[0] if not k else None, short[3]))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
        return parts
    return start


def _running(batches):
    """Of rows in order: the task, their place there, the tokens before them, and both where their conversation begins there."""
    import pyarrow as pa

    task, at, total, begin, conv, first = TaskContext.get().partitionId(), 0, 0, (0, 0), None, True
    for b in batches:
        rows = []
        for key, n in zip(b.column("conv_id").to_pylist(), b.column("n").to_pylist()):
            if first or key != conv:
                conv, begin, first = key, (at, total), False
            rows.append((task, at, total, *begin))
            at, total = at + 1, total + n
        found = [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)]
        yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, *_PLACES])


_PLACES = ("task", "at", "total", "begin_at", "begin_total")


def _with_prefix(parts: DataFrame) -> DataFrame:
    """The rows in order with `conv` (a number of the conversation), `place` in it and `prefix`, the tokens before."""
    order = ["conv_id", "turn", "role", "h", "part"]
    ordered = parts.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = save(ordered.mapInArrow(_running, T.StructType([*ordered.schema.fields, *(T.StructField(c, T.LongType()) for c in _PLACES)])), "turns")
    # one row a task; a task's first conversation can have begun before it
    tasks = rows.groupBy("task").agg(
        F.count("*").alias("n"), F.sum("n").alias("tokens"), F.min_by("conv_id", "at").alias("first"), F.max_by("conv_id", "at").alias("last"),
        F.max("begin_at").alias("begin_at"), F.max("begin_total").alias("begin_total")).orderBy("task").collect()
    offsets, place, total, began, before = [], 0, 0, (0, 0), None
    for t in tasks:
        if before is None or before["last"] != t["first"]:
            began = (place, total)
        offsets.append((t["task"], place, total, *began))
        if t["begin_at"]:
            began = (place + t["begin_at"], total + t["begin_total"])
        place, total, before = place + t["n"], total + t["tokens"], t
    table = rows.sparkSession.createDataFrame(offsets, "task long, places long, totals long, first_place long, first_total long")
    inside = F.col("begin_at") > 0
    return rows.join(F.broadcast(table), "task").select(
        "conv_id", "role", "piece", "a", "b", "n", "short", "n_short",
        F.when(inside, F.col("places") + F.col("begin_at")).otherwise(F.col("first_place")).alias("conv"),
        (F.col("places") + F.col("at") - F.when(inside, F.col("places") + F.col("begin_at")).otherwise(F.col("first_place"))).alias("place"),
        (F.col("totals") + F.col("total") - F.when(inside, F.col("totals") + F.col("begin_total")).otherwise(F.col("first_total"))).alias("prefix"))


WINDOWS = "window long, n_context int, n_turns int, n_tokens long, text string, loss_start array<long>, loss_end array<long>"


def _windows(budget: int, history: int, target: str):
    def windows(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        group, conv, system, past, context, new, used, number = None, None, None, [], [], [], 0, 0

        def row():
            text, starts, ends, at = [], [], [], 0
            for i, (piece, a, b, _, _, role) in enumerate([*context, *new]):
                if i >= len(context) and role == target:
                    starts.append(at + a)
                    ends.append(at + b)
                text.append(piece)
                at += len(piece)
            return (conv, group[1] * SECTION * budget + number, len(context), len(context) + len(new), used, "".join(text), starts, ends)

        def batch(out, kind):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate([kind, *kinds])], names=NAMES)

        kind = None
        for p in batches:
            out, kind = [], p.schema.field("conv_id").type
            for r in p.to_pylist():
                if group != (r["conv"], r["section"]):
                    if new:
                        out.append(row())
                    group, conv = (r["conv"], r["section"]), r["conv_id"]
                    system, past, context, new, used, number = None, [], [], [], 0, 0
                part = (r["piece"], r["a"], r["b"], r["n"], r["prefix"], r["role"])
                if r["kind"] == 0:
                    system = part
                    continue
                if r["kind"] == 1:
                    past.append(part)
                    continue
                starts_section = not new and not number and r["section"] > 0
                if starts_section or new and used + r["n"] > budget:
                    if new:
                        out.append(row())
                        number += 1
                    head = [system] if system else []
                    fixed = sum(x[3] for x in head) + r["n"]
                    room = min(history, budget - fixed)
                    low = 0
                    while low < len(past) and r["prefix"] - past[low][4] > room:  # prefix sums: past[low:] holds that many tokens
                        low += 1
                    context, new = head + past[low:], []
                    used = fixed - r["n"] + (r["prefix"] - past[low][4] if low < len(past) else 0)
                if r["place"] == 0 and r["short"] is not None:
                    system = (r["short"], 0, 0, r["n_short"], 0, r["role"])
                else:
                    past.append(part)
                    while r["prefix"] + r["n"] - past[0][4] - past[0][3] >= history and len(past) > 1:
                        past.pop(0)
                new.append(part)
                used += r["n"]
            if out:
                yield batch(out, kind)
        if new:
            yield batch([row()], kind)
    return windows


NAMES = ["conv_id", *(c.split()[0] for c in WINDOWS.split(", "))]


def windows(turns: DataFrame, path: str, pattern: str, budget: int = 2048, history: int = 256,
            target: str = "assistant") -> DataFrame:
    """(conv_id, window, n_context, n_turns, n_tokens, text, loss_start, loss_end): a row a window. Window
    numbers grow along a conversation; n_context and n_turns count turns and parts of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.md5(text).alias("h"),
                        F.concat(F.length(role).cast("string"), F.lit(":"), role, text).alias("packed"))
    rows = _with_prefix(save(annotate(rows, ["conv_id", "turn", "role", "h"], "packed", _parts(path, pattern, budget),
                                      "part int, piece string, a long, b long, n long, short string, n_short long", many=True), "parts"))
    length = SECTION * budget
    own = rows.withColumn("section", F.expr(f"prefix div {length}")).withColumn("kind", F.lit(2))
    # what a section repeats: the last turns of the one before, and the system turn
    before = own.where((F.col("prefix") + F.col("n") > (F.col("section") + 1) * length - history) & (F.col("short").isNull() | (F.col("place") > 0)))
    before = before.withColumn("section", F.col("section") + 1).withColumn("kind", F.lit(1))
    long = own.groupBy("conv").agg(F.max("section").alias("last")).where(F.col("last") > 0)
    system = (own.where("place = 0 AND short IS NOT NULL").join(long, "conv")
              .withColumn("section", F.explode(F.sequence(F.lit(1).cast("long"), "last"))).drop("last")
              .withColumn("piece", F.col("short")).withColumn("n", F.col("n_short")).withColumn("kind", F.lit(0)))
    sections = own.unionByName(before).unionByName(system).repartition(F.col("conv"), F.col("section"))
    kind = T.StructField("conv_id", turns.schema["conv_id"].dataType)
    return (sections.sortWithinPartitions("conv", "section", "kind", "place")
            .mapInArrow(_windows(budget, history, target), T.StructType([kind, *T.StructType.fromDDL(WINDOWS).fields])))


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back():
    def read(batches):
        import hashlib

        import pyarrow as pa

        conv, started, state, kind = None, False, None, None

        def row():
            n, turns, chars, loss, formatted, _ = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

        def batch(out):
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)],
                                              names=["conv_id", *(c.split()[0] for c in DIGESTS.split(", "))])

        for p in batches:
            out, kind = [], p.schema.field("conv_id").type
            for r in p.to_pylist():
                if not started or r["conv_id"] != conv:
                    if started:
                        out.append(row())
                    conv, started, state = r["conv_id"], True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, said, ends in parse(r["text"])[r["n_context"]:]:
                    if not state[5]:  # not the rest of a turn
                        state[0] += 1
                        state[1].update(f"{role}\n".encode())
                    state[1].update(said.encode())
                    if ends:
                        state[1].update(b"\n")
                    state[5] = not ends
                for a, b in zip(r["loss_start"], r["loss_end"]):
                    said = unescape(r["text"][a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(r["text"])
            if out:
                yield batch(out)
        if started:
            yield batch([row()])
    return read


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted windows hold: every turn once, and all text under the loss mask."""
    kind = T.StructField("conv_id", formatted.schema["conv_id"].dataType)
    return (formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "window")
            .select("conv_id", "n_context", "text", "loss_start", "loss_end")
            .mapInArrow(_read_back(), T.StructType([kind, *T.StructType.fromDDL(DIGESTS).fields])))
