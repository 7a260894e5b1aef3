"""Chat formatting (2): transcripts to canonical turns by a hidden Markov model.

A transcript is a sequence of lines, some with a speaker marker ("User:", "### Assistant", ...), many without. The
hidden state of a line is its speaker, together with whether the line begins a turn; what is seen of it is its marker and
a few features of its form. Start, transition and emission probabilities are counted on labelled transcripts (or
given), and Viterbi finds the likeliest speakers. Turns are then rendered in one form, a line at a time:
the first line of a turn carries the opening, the last one the closing, so that the lines of a conversation in order are
the canonical transcript.

A conversation may be of any length, and one may hold most of the lines: lines are numbered by a range-partitioned sort and cut
into segments of SEGMENT lines. The best path through a segment from each entry state to each exit state is a small max-plus
matrix. FAN neighbouring matrices multiply to one, level by level, until a conversation has one left; on the way back
each product's entry and exit fix the states at the borders of its FAN parts, and each segment then finds its own path.
Nothing holds more than a segment or FAN matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

ROLES = ("system", "user", "assistant")
#: States: each role, beginning a turn or going on in one.
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Lines of a segment, and matrices that multiply at a time.
SEGMENT, FAN = 256, 64
#: What speakers are called in transcripts (fixed values).
MARKERS = {"system": "system|sys|instructions?", "user": "user|human|question|q|customer|client|me", "assistant": "assistant|ai|bot|answer|a|agent|model|gpt"}
#: Lengths from which a line's form is another one, and values of a form: end (question, full stop, other) x length x first of its transcript.
LENGTHS = (1, 40, 120, 250, 400)
FORMS = 3 * (len(LENGTHS) + 1) * 2
SYMBOLS = (len(ROLES) + 1) * FORMS
OPEN, CLOSE = "<|im_start|>%s\n", "<|im_end|>\n"
#: Pseudo-counts of a state's forms, starts and moves, and of its markers: few, so that a marker outweighs any form.
SMOOTHING, MARKER_SMOOTHING = 0.5, 1e-5


def _mark(names: str) -> str:
    """A pattern for a speaker's marker: a name with a colon (bold or a heading or not) or a prompt sign, or a name of over two letters in
    brackets, or as a heading or in bold alone in its line. A name without any of these is text."""
    long = "|".join(n for n in names.split("|") if len(n.rstrip("?")) > 2)
    forms = [rf"(?:#{{1,4}}\s*)?\*{{0,2}}(?:{names})\*{{0,2}}\s*[:>]\*{{0,2}}", rf"#{{1,4}}\s*(?:{long})\s*$", rf"\*\*(?:{long})\*\*\s*$", rf"<\|(?:{long})\|>", rf"\[(?:{long})\]", rf"<(?:{long})>"]
    return rf"(?i)^\s*(?:{'|'.join(forms)}) ?"


ANY_MARK = _mark("|".join(MARKERS.values()))


def marker(line: Column) -> Column:
    """Number of the role whose marker a line begins with, the number of roles if none."""
    out = F.lit(len(ROLES))
    for k, role in reversed([*enumerate(ROLES)]):
        out = F.when(line.rlike(_mark(MARKERS[role])), F.lit(k)).otherwise(out)
    return out


def look(line: Column) -> Column:
    """A line's marker, end and length as one number."""
    body = F.rtrim(F.regexp_replace(line, ANY_MARK, ""))
    end = F.when(body.endswith("?"), 0).when(body.rlike("[.!]$"), 1).otherwise(2)
    size = sum((F.when(F.length(body) >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    return ((marker(line) * 3 + end) * (len(LENGTHS) + 1) + size).cast("int")


def escaped(text: Column) -> Column:
    """A body in which nothing reads as an opening or closing: each of their beginnings gets a backslash more."""
    return F.regexp_replace(text, r"<\|(\\*)im_", r"<|\\$1im_")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|\\(\\*)im_", r"<|$1im_")


class Hmm:
    """Log probabilities of starts, transitions and emissions."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def counted(start: dict, move: dict, emit: dict) -> Hmm:
        """From counts by state numbers; continuing lines only follow lines of their own role. Markers and forms are independent given the
        state, each with its own smoothing, so that an unseen form never hides what a marker says."""
        n = len(STATES)
        s, m = np.full(n, SMOOTHING), np.full((n, n), SMOOTHING)
        marks, forms = np.full((n, SYMBOLS // FORMS), MARKER_SMOOTHING), np.full((n, FORMS), SMOOTHING)
        for k, v in start.items():
            s[k] += v
        for (a, b), v in move.items():
            m[a, b] += v
        for (a, b), v in emit.items():
            marks[a, b // FORMS] += v
            forms[a, b % FORMS] += v
        for b, (role, begins) in enumerate(STATES):
            if not begins:
                s[b] = 0
                m[[a for a, (r, _) in enumerate(STATES) if r != role], b] = 0
        with np.errstate(divide="ignore"):
            marks, forms = (np.log(x / x.sum(1, keepdims=True)) for x in (marks, forms))
            e = (marks[:, :, None] + forms[:, None, :]).reshape(n, SYMBOLS)
            return Hmm(np.log(s / s.sum()), np.log(m / m.sum(1, keepdims=True)), e)


def split_lines(conversations: DataFrame, conv_id: str, turn: str, role: str | None, text: str) -> DataFrame:
    """conv_id, turn, line, text (and state, if roles are given) of each line; null texts are one empty line."""
    whole = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\r\n|\n|\r")
    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), *([F.lower(F.col(f"`{role}`")).alias("role")] if role else []), F.posexplode(whole).alias("line", "text"))
    if not role:
        return rows
    state = F.lit(None).cast("int")
    for k, (name, begins) in enumerate(STATES):
        state = F.when((F.col("role") == name) & ((F.col("line") == 0) == begins), F.lit(k)).otherwise(state)
    return rows.withColumn("state", state)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def placed(lines: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The lines with ``row``, a number of their own, and the places of these: conv_id, row, at, segment and symbol (and state, if lines have one).

    ``at`` is a line's number in its transcript; ties in ``order`` fall by the line's text. A transcript may reach over several
    ranges of the sort; a line's number is its place in its range plus the lines in the ranges before. Texts are moved once here;
    all that follows works on places, until ``rendered`` brings both together."""
    keys = ["conv_id", *order, "text"]
    lines = stored(lines.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"row": F.monotonically_increasing_id(), "look": look(F.col("text"))}), "transcript")
    rows = lines.select("conv_id", "row", "look", *(["state"] if "state" in lines.columns else [])).withColumn("__part", F.shiftright("row", 33))
    before = Window.partitionBy("__c").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("conv_id").alias("__c"), F.col("__part").alias("__p")).agg(F.min("row").alias("__low"), F.count("*").alias("__n"))
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # a row for each transcript and range that it reaches into
    places = rows.join(starts, _same("conv_id", "__c") & (F.col("__part") == F.col("__p"))).withColumn("at", (F.col("row") - F.col("__low") + F.col("__before")).cast("int"))
    places = places.withColumn("segment", F.floor(F.col("at") / SEGMENT).cast("int")).withColumn("symbol", F.col("look") * 2 + (F.col("at") == 0).cast("int"))
    return lines, stored(places.drop("look", "__part", "__c", "__p", "__low", "__n", "__before"), "places")


def learn(rows: DataFrame) -> Hmm:
    """From lines with ``at``, ``symbol`` and ``state``: grouped counts, a few hundred numbers."""
    known = rows.select("conv_id", "at", "symbol", "state").where("state is not null")
    earlier = known.select(F.col("conv_id").alias("__c"), (F.col("at") + 1).alias("__a"), F.col("state").alias("before"))
    known = known.join(earlier, _same("conv_id", "__c") & (F.col("at") == F.col("__a")), "left")
    counts = known.groupBy("before", "state", "symbol", (F.col("at") == 0).alias("first")).count().collect()  # at most states squared times symbols
    start, move, emit = {}, {}, {}
    for r in counts:
        emit[r["state"], r["symbol"]] = emit.get((r["state"], r["symbol"]), 0) + r["count"]
        if r["first"]:
            start[r["state"]] = start.get(r["state"], 0) + r["count"]
        elif r["before"] is not None:
            move[r["before"], r["state"]] = move.get((r["before"], r["state"]), 0) + r["count"]
    return Hmm.counted(start, move, emit)


def best_paths(hmm: Hmm, symbols: np.ndarray, entry: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the best paths over a segment by exit state (columns) and entry state (rows), and the back pointers.

    The entry state is the one of the line before; None stands for the start of a transcript, where all rows are equal."""
    n = len(STATES)
    first = np.tile(hmm.start, (n, 1)) if entry is None else hmm.move
    score = first + hmm.emit[:, symbols[0]]
    back = np.zeros((len(symbols), n, n), np.int8)
    for t in range(1, len(symbols)):
        through = score[:, :, None] + hmm.move[None]
        back[t] = through.argmax(1)
        score = np.take_along_axis(through, back[t][:, None, :].astype(np.int64), 1)[:, 0] + hmm.emit[:, symbols[t]]
    return score, back


def multiplied(tables: list[np.ndarray]) -> np.ndarray:
    """The max-plus product of matrices: best scores through all of them by entry and exit."""
    out = tables[0]
    for m in tables[1:]:
        out = (out[:, :, None] + m[None]).max(1)
    return out


def between(tables: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """The exit state of each matrix on the best way from ``entry`` to ``exit_`` through all of them."""
    score, back = tables[0][entry], []
    for m in tables[1:]:
        through = score[:, None] + m
        back.append(through.argmax(0))
        score = through.max(0)
    exits = [exit_]
    for b in reversed(back):
        exits.append(int(b[exits[-1]]))
    return exits[::-1]


def borders(matrices: DataFrame) -> DataFrame:
    """conv_id, segment, entry and exit: the states of the best paths before and at the end of each segment.

    ``matrices`` (conv_id, segment, score) has a row for each segment; entries of a transcript's first segment count nothing."""
    n = len(STATES)
    kind = matrices.schema["conv_id"].dataType.simpleString()
    made = pa.schema([("conv_id", _arrow(kind)), ("segment", pa.int32()), ("score", pa.list_(pa.float64()))])
    ends = pa.schema([("conv_id", _arrow(kind)), ("segment", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32())])
    square = lambda p: np.array(p["score"]).reshape(n, n)

    def blocks(level: DataFrame) -> DataFrame:  # FAN parts at most in each
        return level.groupBy("conv_id", F.floor(F.col("segment") / FAN).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("segment", "score"))).alias("parts"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(conv, block, multiplied([*map(square, parts)]).ravel().tolist()) for conv, block, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True)], made)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts, entry, exit_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                exits = between([*map(square, parts)], entry, exit_)
                out += [(conv, p["segment"], e, x) for p, e, x in zip(parts, [entry, *exits[:-1]], exits, strict=True)]
            yield _batch(out, ends)

    levels = [matrices]
    while levels[-1].agg(F.max("segment")).first()[0]:
        levels.append(stored(blocks(levels[-1]).mapInArrow(multiply, f"conv_id {kind}, segment int, score array<double>"), "products"))
    row = F.slice("score", 1, n)
    fixed = levels[-1].select("conv_id", "segment", F.lit(0).alias("entry"), (F.array_position(row, F.array_max(row)) - 1).cast("int").alias("exit"))
    for level in levels[-2::-1]:
        of = fixed.withColumnsRenamed({"conv_id": "__c", "segment": "__b"})
        both = blocks(level).join(of, _same("conv_id", "__c") & (F.col("block") == F.col("__b"))).select("conv_id", "parts", "entry", "exit")
        fixed = both.mapInArrow(split, f"conv_id {kind}, segment int, entry int, exit int")
    return fixed


def roles(places: DataFrame, hmm: Hmm) -> DataFrame:
    """``places`` (conv_id, row, at, segment, symbol) with ``state``: Viterbi over whole transcripts."""
    kind = places.schema["conv_id"].dataType.simpleString()
    made = pa.schema([("conv_id", _arrow(kind)), ("segment", pa.int32()), ("score", pa.list_(pa.float64()))])
    found = pa.schema([("conv_id", _arrow(kind)), ("segment", pa.int32()), ("at", pa.int32()), ("row", pa.int64()), ("state", pa.int32())])

    def to_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for conv, segment, _, symbols in _runs(batches, ["conv_id", "segment"]):
            score, _ = best_paths(hmm, symbols, None if segment == 0 else 0)
            held.append((conv, segment, score.ravel().tolist()))
            if len(held) >= 2000:
                yield _batch(held, made)
                held = []
        yield _batch(held, made)

    def to_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for conv, segment, entry, exit_, row, symbols in _runs(batches, ["conv_id", "segment", "entry", "exit"]):
            _, back = best_paths(hmm, symbols, None if segment == 0 else 0)
            state, path = int(exit_), []
            for t in range(len(symbols) - 1, -1, -1):
                path.append(state)
                state = int(back[t, int(entry), state])
            first = segment * width
            held += [(conv, segment, first + t, r, x) for t, (r, x) in enumerate(zip(row.tolist(), reversed(path), strict=True))]
            if len(held) >= 10_000:
                yield _batch(held, found)
                held = []
        yield _batch(held, found)

    width = SEGMENT
    narrow = places.select("conv_id", "segment", "row", "symbol")  # rows of a transcript ascend as its lines do
    in_segments = narrow.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "row")
    fixed = borders(stored(in_segments.mapInArrow(to_matrix, f"conv_id {kind}, segment int, score array<double>"), "segments"))
    both = narrow.join(fixed.withColumnsRenamed({"conv_id": "__c", "segment": "__s"}), _same("conv_id", "__c") & (F.col("segment") == F.col("__s"))).drop("__c", "__s")
    sorted_rows = both.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "row")
    return sorted_rows.mapInArrow(to_states, f"conv_id {kind}, segment int, at int, row long, state int")


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """``names``' values, rows and symbols of each segment, from rows sorted by conversation, segment and row."""
    key, held = None, []

    def whole():
        return (*key, *(np.concatenate([h[i] for h in held]) for i in range(2)))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [*zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True)]
        row, symbols = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("row", "symbol"))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != key:
                    yield whole()
                    held = []
                key = keys[start]
                held.append((row[start:i], symbols[start:i]))
                start = i
    if held:
        yield whole()


def rendered(lines: DataFrame, states: DataFrame) -> DataFrame:
    """``lines`` with at, role, begins and rendered: opening, the text without its marker, and the closing after a turn's last line. Openings and
    closings inside texts are ``escaped``.

    A turn begins where the state says so, as going on is only possible in one's own role."""
    role = F.get(F.array(*(F.lit(r) for r, _ in STATES)), F.col("state"))
    begins = F.get(F.array(*(F.lit(b) for _, b in STATES)), F.col("state"))
    turns = states.withColumns({"role": role, "begins": begins | (F.col("at") == 0)})
    # the next line is in the same segment, or the first of the next one
    firsts = turns.where(F.col("at") % SEGMENT == 0).where("segment > 0").select(F.col("conv_id").alias("__c"), (F.col("segment") - 1).alias("__s"), F.col("begins").alias("__next"))
    inside = F.lead("begins").over(Window.partitionBy("conv_id", "segment").orderBy("at"))
    turns = turns.withColumn("__inside", inside).join(firsts, _same("conv_id", "__c") & (F.col("segment") == F.col("__s")), "left")
    turns = turns.select("row", "at", "role", "begins", F.coalesce("__inside", "__next", F.lit(True)).alias("__last"))
    body = escaped(F.when(F.col("begins"), F.regexp_replace("text", ANY_MARK, "")).otherwise(F.col("text")))
    opening = F.when(F.col("begins"), F.format_string(OPEN, F.col("role"))).otherwise(F.lit(""))
    out = lines.drop("at", "role", "begins", "state").join(turns, "row")
    return out.withColumn("rendered", F.concat(opening, body, F.when(F.col("__last"), F.lit("\n" + CLOSE)).otherwise(F.lit("\n")))).drop("__last", "row", "look")


def parse(lines: DataFrame, hmm: Hmm, order: list[str]) -> DataFrame:
    """Transcript lines (conv_id, text and the columns of ``order``) with at, role, begins and rendered; other columns of these names,
    and of the names row, look and state, give way.

    Null conv_ids are one transcript; null texts are empty lines; repeated rows are lines each."""
    lines, places = placed(lines.drop("state", "row", "look").withColumn("text", F.coalesce("text", F.lit(""))), order)
    return rendered(lines, stored(roles(places, hmm), "states"))


#: Spellings of markers in the transcripts that the query makes of a table of turns.
SPELLINGS = (("System: ", "User: ", "Assistant: "), ("**System:** ", "**Human:** ", "**AI:** "), ("[system] ", "[user] ", "[assistant] "), ("SYS> ", "Q: ", "A: "))


def unmarked(conv_id: Column, turn: Column) -> Column:
    """Whether a raw transcript leaves a turn's speaker out: one turn in three, by a hash."""
    return F.pmod(F.xxhash64(conv_id, turn), F.lit(3)) == 0


def transcript_query(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, line, role (as recovered), begins, marked, n_chars and rendered_sha256 of each line of all conversations.

    The table's turns become raw transcripts first: their lines, with a marker in one of the SPELLINGS on two thirds of the turns.
    Probabilities come from the conversations whose id hash leaves 1 to 4 by 5; the others are only parsed."""
    style = F.get(F.array(*(F.array(*map(F.lit, x)) for x in SPELLINGS)), F.pmod(F.xxhash64("conv_id", F.lit(9)), F.lit(len(SPELLINGS))).cast("int"))
    mark = F.get(style, (F.array_position(F.array(*map(F.lit, ROLES)), F.lower("role")) - 1).cast("int"))
    shown = F.when(unmarked(F.col("conv_id"), F.col("turn")), F.lit("")).otherwise(F.coalesce(mark, F.lit("")))
    raw = conversations.select("conv_id", "turn", "role", F.concat(shown, F.coalesce("text", F.lit(""))).alias("text"))
    lines, places = placed(split_lines(raw, "conv_id", "turn", "role", "text"), ["turn", "line"])
    hmm = learn(places.where(F.pmod(F.xxhash64("conv_id"), F.lit(5)) > 0))
    out = rendered(lines, stored(roles(places.drop("state"), hmm), "states"))
    marked = (marker(F.col("text")) < len(ROLES)).alias("marked")
    return out.select("conv_id", "turn", "line", "role", "begins", marked, F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
