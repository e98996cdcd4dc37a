"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. The prefixes of a conversation are rendered one turn longer at a time;
where the longer output starts with the shorter, the rest is the new turn's span. Where it does not, the template
rewrites history, which is reported, and the span starts where the two outputs part. Rendering a turn once more with a
mark for its text tells header and trailer apart, so the loss mask covers the text alone.

If a template renders two lists of turns as it renders them joined (probed on the driver, and again on the real turns of
every segment), long conversations are cut into segments that tasks render apart, so a task holds the turns of one
segment. Any other template sees each conversation whole, since a black box may look back any distance: a task then holds
one conversation, and rendering it costs the square of its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import by_rows, written

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Turns in a segment; a segment is a row of the output.
SEGMENT = 256
MARK = "\ue000"
#: The control strings of the default template.
HEAD, MIDDLE, TAIL = "### ", ":\n", "\n</turn>\n"
FORMATTED = "conv_id string, part long, number long, text string, starts array<long>, ends array<long>, rewrites long"


def escaped(text: str) -> str:
    """A text in which no control string of the template can occur: a backslash before backslash, #, <, : and line ends."""
    return re.sub(r"[\\#<:\n]", r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def default_template(turns: Turns) -> str:
    """Each turn as a marked role, its text and an end mark; strings of the sort inside roles and texts are escaped."""
    return "".join(f"{HEAD}{escaped(role)}{MIDDLE}{escaped(text)}{TAIL}" for role, text in turns)


def default_turns(text: str) -> Turns:
    """The turns of a text that the default template rendered."""
    found = re.findall(r"### ((?:\\.|[^\\:])*):\n((?:\\.|[^\\\n])*)\n</turn>\n", text, flags=re.DOTALL)
    return [(unescaped(r), unescaped(t)) for r, t in found]


def common(a: str, b: str) -> int:
    """How many characters two texts share at their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def spans(turns: Turns, template: Template, local: bool = False) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """Renders turns: the whole text; of each turn the span that it added and its text's place in the whole; rewrites.

    Prefixes are rendered one turn longer at a time, which costs the square of the turns. The place of a text is found by rendering all turns with a mark in its stead (of a local
    template, that turn alone), so it is right in the final text even where later turns rewrite earlier ones; a text that the template leaves out has the place (0, 0).
    """
    shown, added, rewrites = "", [], 0
    for i in range(len(turns)):
        after = template(turns[: i + 1])
        at = len(shown)
        if not after.startswith(shown):
            rewrites += 1
            at = common(shown, after)
        added.append((at, len(after)))
        shown = after
    out = []
    for i, (role, _) in enumerate(turns):
        begin, end = added[i] if local else (0, len(shown))
        marked = template([(role, MARK)] if local else [*turns[:i], (role, MARK), *turns[i + 1 :]])
        inner = marked.rfind(MARK) if turns[i][1] == MARK else marked.find(MARK)
        out.append((*added[i], begin + inner, end - (len(marked) - inner - len(MARK))) if inner >= 0 else (*added[i], 0, 0))
    return shown, out, rewrites


def is_local(template: Template) -> bool:
    """Whether the template renders lists of turns one after the other as it renders them joined, on probes."""
    probes: list[Turns] = [[("user", "a")], [("assistant", "b"), ("user", "c")], [("system", ""), ("assistant", "### x </turn>")], [("user" if i % 2 else "assistant", str(i)) for i in range(40)]]
    return all(template(a + b) == template(a) + template(b) for a in probes for b in probes)


def cut_up(text: str, loss: list[tuple[int, int]], every: int) -> list[tuple[str, list[int], list[int]]]:
    """A rendered text and its loss spans in slices that end before every so many-th span, where spans are in order."""
    ordered = all(a[1] <= b[0] for a, b in zip(loss, loss[1:], strict=False))
    cuts = [0, *[a for a, _ in loss[every::every] if ordered], len(text)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = [(x - a, y - a) for x, y in loss if a <= x < b or (x == b == len(text))]
        out.append((text[a:b], [x for x, _ in own], [y for _, y in own]))
    return out


def formatted(turns: DataFrame, template: Template = default_template, local: bool | None = None) -> DataFrame:
    """Rows (conv_id, part, number, text, starts, ends, rewrites): slices of rendered conversations in order, with loss spans.

    turns: conv_id, turn, role, text. Null texts and roles are empty. Turns go by (turn, role, text), null turns first;
    repeated rows are turns. A null conv_id is a conversation. Very long texts and conversations are rendered whole. An
    empty table gives none; other columns are ignored, whatever their names. starts and ends are the assistant texts'
    places in the slice.

    Only a template that renders turns one by one may see a conversation in segments, and no probe can tell that of a black
    box: one may change after any number of turns. So `local` is the caller's word; without it all templates but our own
    see whole conversations. A template that is called local but fails the probes, or whose segments are not what their
    halves give, fails the job.
    """
    local = template is default_template if local is None else local
    if local and not is_local(template):
        raise ValueError("the template does not render turns one by one; pass local=False")
    rows = turns.select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-1)).cast("long") if local else F.lit(0).cast("long"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, number = None, [], 0

        def flush() -> list[tuple]:
            nonlocal number
            text, found, rewrites = spans(held, template, local)
            half = len(held) // 2
            if local and template(held[:half]) + template(held[half:]) != text:
                raise ValueError(f"conversation {key[0]}: the template does not render turns one by one; pass local=False")
            loss = [(a, b) for (_, _, a, b), (role, _) in zip(found, held, strict=True) if role == "assistant" and (a, b) != (0, 0)]
            slices = [(text, [a for a, _ in loss], [b for _, b in loss])] if local else cut_up(text, loss, SEGMENT // 2)
            out = [(*key, number + i, *x, rewrites if not i else 0) for i, x in enumerate(slices)]
            number += len(out)
            return out

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["conv_id", "part", "number", "text", "starts", "ends", "rewrites"])

        for batch in batches:
            out = []
            for conv, part, role, text in zip(*[batch[c].tolist() for c in ("conv_id", "part", "role", "text")], strict=True):
                if (conv, part) != key or (local and len(held) >= SEGMENT):
                    out += flush() if key is not None else []
                    number = number if (conv, part) == key else 0
                    key, held = (conv, part), []
                held.append((role, text))
            yield frame(out)
        if key is not None:
            yield frame(flush())

    order = ["conv_id", "part", "turn", "role", "text"]
    return by_rows(rows.repartition("conv_id", "part").sortWithinPartitions(*order).select("conv_id", "part", "role", "text"), render, FORMATTED)


def read_back(segments: DataFrame) -> DataFrame:
    """What the written segments say of each conversation (op7's contract). Segments come in order; digests are updated by segment.

    A digest over a conversation's turns is sequential, so the segments of one conversation are read by one task, one at
    a time.
    """

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, first = None, None, True

        def done() -> list[tuple]:
            return [] if state is None else [(conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])]

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for key, text, starts, ends in zip(*[batch[c].tolist() for c in ("conv_id", "text", "starts", "ends")], strict=True):
                if first or key != conv:
                    out += done()
                    conv, state, first = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], False
                turns = default_turns(text)
                state[0] += len(turns)
                state[1].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                loss = "".join(unescaped(text[a:b]) for a, b in zip(starts, ends, strict=True))
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(done(), columns=columns)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").select("conv_id", "text", "starts", "ends")
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return by_rows(ordered, tell, schema).withColumn("conv_id", F.col("conv_id").cast("long"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one that tries to forge control strings, and reads them back from what was written."""
    hard = "\\### Assistant: </turn> ok"
    forged = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(forged)
    return read_back(written(formatted(turns), "chat"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, x.turn, x.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)
), e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:' || chr(10) || ']', '', 'g')) + 15 AS shown FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
