"""Operator 10: roles of transcript lines by a hidden Markov model, and canonical turns.

A state is a role at the first line of a turn or within it. A line shows its
speaker marker (a known name of a role before a colon or in brackets, another
name, or none), whether it is the first line or follows an empty one, whether it ends with a question mark, and
its length class. Counts over labelled transcripts give initial, transition and
emission probabilities with add-one smoothing; Viterbi recovers the states, and
lines from one turn start to the next are one turn.

Rows are sorted by (id, place, text) over all partitions, and each partition is
cut as it streams by into segments of at most ``SEGMENT`` lines, which carry what
stands before them; so neither a long transcript nor a long text is gathered in
one task. A segment of a longer transcript is reduced to a matrix: the best
log-probability from each state before it to each state at its end (products in
the max-plus semiring). Matrices of neighbouring segments multiply ``FAN`` at a time
up to one for each transcript, whose best end is then handed down again to every
segment, which traces its own lines. The pieces of a turn that crosses a cut are
joined before it is rendered: the result is the same for any cut.

Defined cases: null text is an empty line; rows of one transcript with equal
position are ordered by text, and repeated rows are turns of their own; a null or
negative position comes before all others in its order; a null id is an id;
without labelled rows the markers alone decide (a fixed start model); very long
texts and transcripts are cut; of equally likely paths one is taken (rounding may
choose another for another cut); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.llm.common import fold, text_or_empty, written

ROLES = ("system", "user", "assistant")
#: States: 2 * role for a turn's first line, 2 * role + 1 within the turn.
STATES = 2 * len(ROLES)
#: Names that mark a role (in lower case).
NAMES = {
    "system": "system instructions context",
    "user": "user human q customer me you student",
    "assistant": "assistant ai bot a agent model gpt teacher",
}
_ROLE_OF = {name: i for i, r in enumerate(ROLES) for name in NAMES[r].split()}
#: A bare dash marks a role only before white space ("A - yes", not "A-level").
_MARKER = re.compile(r"^\s*+(?:[>*#\-]++\s*+)?[\[<(*]{0,2}([A-Za-z][A-Za-z ]{0,20}?)[\]>)*]{0,2}\s*+(:|\]|>|-(?=\s|$))\s*+")
#: Sizes of the observed features: marker (none, role 0..2, other), position, question, length class.
SIZES = (5, 3, 2, 4)
SEGMENT = 256
#: Matrices that multiply at a time.
FAN = 256


def marker(line: str) -> tuple[int, int]:
    """(marker feature, length of the marker text)."""
    found = _MARKER.match(line)
    if not found:
        return 0, 0
    role = _ROLE_OF.get(found[1].strip().lower())
    if role is None:
        return (4, 0) if found[2] == ":" else (0, 0)
    return role + 1, found.end()


def observed(lines: list[str], first: bool, blank: bool = False) -> list[tuple[int, ...]]:
    """Features of consecutive lines; ``first``: whether they begin a transcript; ``blank``: whether they follow an empty line."""
    out = []
    for i, line in enumerate(lines):
        n = len(line)
        out.append((marker(line)[0], 2 if first and i == 0 else int(blank), int(line.rstrip().endswith("?")), 0 if n < 20 else 1 if n < 80 else 2 if n < 200 else 3))
        blank = not line.strip()
    return out


class RoleModel:
    """Log-probabilities of the hidden Markov model, from counts with add-one smoothing."""

    def __init__(self, start, step, emit):
        import numpy as np

        # a line starts a turn or goes on within the same one
        allowed = np.array([[j % 2 == 0 or j // 2 == i // 2 for j in range(STATES)] for i in range(STATES)])
        begin = np.array([i % 2 == 0 for i in range(STATES)])
        with np.errstate(divide="ignore"):
            self.start = np.log(np.where(begin, start + 1.0, 0) / (start + 1.0)[begin].sum())
            smooth = np.where(allowed, step + 1.0, 0)
            self.step = np.log(smooth / smooth.sum(1, keepdims=True))
        self.emit = [np.log((e + 0.2) / (e + 0.2).sum(1, keepdims=True)) for e in emit]

    @classmethod
    def prior(cls) -> RoleModel:
        """The model without labels: a marker shows its role at a turn's start."""
        import numpy as np

        emit = [np.ones((STATES, n)) for n in SIZES]
        for s in range(STATES):
            emit[0][s, 0] = 4 if s % 2 == 0 else 60
            if s % 2 == 0:
                emit[0][s, s // 2 + 1] = 40
        return cls(np.array([2.0, 0, 4, 0, 1, 0]), np.ones((STATES, STATES)), emit)

    def seen(self, features):
        """(lines, states) log-probabilities of the observations."""
        import numpy as np

        f = np.array(features, "int64").reshape(-1, len(SIZES))
        return sum(e[:, f[:, k]].T for k, e in enumerate(self.emit))

    def reduce(self, features, first: bool):
        """The segment's matrix; the rows of a transcript's first segment are all its start."""
        import numpy as np

        seen = self.seen(features)
        best = np.repeat((self.start + seen[0])[None, :], STATES, 0) if first else self.step + seen[0][None, :]
        for x in seen[1:]:
            best = (best[:, :, None] + self.step[None, :, :]).max(1) + x[None, :]
        return best

    def trace(self, features, entry: int | None, last: int | None) -> list[int]:
        """The best states of the lines, from the state before (None: the start) to the state at the end (None: any)."""
        import numpy as np

        seen = self.seen(features)
        best = (self.start if entry is None else self.step[entry]) + seen[0]
        back = []
        for x in seen[1:]:
            way = best[:, None] + self.step
            back.append(way.argmax(0))
            best = way.max(0) + x
        state = int(best.argmax()) if last is None else last
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


def product(matrices):
    """The matrix of neighbouring segments together."""
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None, :, :]).max(1)
    return out


def cuts(matrices, entry: int | None = None, last: int | None = None) -> list[int]:
    """The state at the end of every segment, from matrices in order, the state before them (None: the start) and the one at their end (None: any)."""
    scores, ways = matrices[0][entry or 0], []
    for m in matrices[1:]:
        way = scores[:, None] + m
        ways.append(way.argmax(0))
        scores = way.max(0)
    state = int(scores.argmax()) if last is None else last
    out = [state]
    for w in reversed(ways):
        state = int(w[state])
        out.append(state)
    return out[::-1]


def pieces(lines: list[str], states: list[int]) -> list[tuple[str, bool, str, list[int]]]:
    """(role, whether the turn starts here, text without its marker, states) of each turn or piece of one; the marker of another role stays."""
    out: list[list] = []
    for line, s in zip(lines, states):
        if s % 2 == 0 or not out:
            role, end = marker(line)
            out.append([ROLES[s // 2], s % 2 == 0, [line[end:] if s % 2 == 0 and role - 1 == s // 2 else line], [s]])
        else:
            out[-1][2].append(line)
            out[-1][3].append(s)
    return [(r, b, "\n".join(t), own) for r, b, t, own in out]


def rendered(role, text):
    """One canonical turn (columns)."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Segments of at most ``segment`` lines of rows (id, place, text, role), as a written table: id, seg (unique, in order), lines, states
    (null where the role is not known), whole (surely all of its transcript), and what comes before: first, blank, before (the state)."""
    kind = rows.schema["id"].dataType.simpleString()
    role = F.coalesce(*[F.when(F.col("role") == r, 2 * i) for i, r in enumerate(ROLES)]).cast("int")
    source = rows.select("id", F.col("place").cast("long").alias("place"), text_or_empty().alias("text"), role.alias("role"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["id", "seg", "lines", "states", "whole"]
        seg, done, none = TaskContext.get().partitionId() << 32, [], object()
        last, began, lines, states, size, id_kind = none, False, [], [], 0, None

        def cut(ends: bool):
            nonlocal seg, lines, states, size
            done.append((last, seg, lines, states, began and ends))
            seg, lines, states, size = seg + 1, [], [], 0

        def out():
            kinds = [id_kind, pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names=names)

        held = 0
        for batch in batches:
            id_kind = batch.schema.field("id").type
            for i, text, state in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "role"))):
                if last is none or i != last:
                    # began: the segment opens a transcript whose start is in this partition for sure
                    fresh = last is not none
                    if lines:
                        cut(True)
                    last, began = i, fresh
                for n, line in enumerate(text.split("\n")):
                    if size >= segment:
                        cut(False)
                        began = False
                    lines.append(line)
                    states.append(None if state is None else state + (n > 0))
                    size += 1
                    held += len(line) + 16
                    if held > 1 << 22 and done:
                        yield out()
                        done, held = [], 0
        if lines:
            cut(False)
        if done:
            yield out()

    ordered = source.repartitionByRange("id", "place", "text", "role").sortWithinPartitions("id", "place", "text", "role").select("id", "text", "role")
    cut = written(ordered.mapInArrow(run, f"id {kind}, seg long, lines array<string>, states array<int>, whole boolean"), "segments")
    # what stands before a segment: one narrow row of each segment of a transcript of several
    tail = cut.where("NOT whole").select("id", "seg", (F.trim(F.regexp_replace(F.element_at("lines", -1), r"\s", " ")) == "").alias("b"), F.element_at("states", -1).alias("s"))
    w = Window.partitionBy("id").orderBy("seg")
    tail = tail.select("seg", F.lag("seg").over(w).isNull().alias("first"), F.coalesce(F.lag("b").over(w), F.lit(False)).alias("blank"), F.lag("s").over(w).alias("before"))
    own = cut.where("whole").withColumn("first", F.lit(True)).withColumn("blank", F.lit(False)).withColumn("before", F.lit(None).cast("int"))
    return written(own.unionByName(cut.where("NOT whole").join(written(tail, "tails"), "seg")), "segments")


def fit(lines: DataFrame) -> RoleModel:
    """The model from the lines of known state of ``segments``; the counts are a table of fixed size."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros((STATES, n)) for n in SIZES]
        for batch in batches:
            for texts, states, first, blank, before in zip(*(batch.column(c).to_pylist() for c in ("lines", "states", "first", "blank", "before"))):
                if first and states[0] is not None:
                    start[states[0]] += 1
                for a, s, f in zip([before, *states], states, observed(texts, first, blank)):
                    if s is None:
                        continue
                    if a is not None:
                        step[a, s] += 1
                    for k, x in enumerate(f):
                        emit[k][s, x] += 1
        flat = np.concatenate([start, step.ravel(), *(e.ravel() for e in emit)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype="int32")), pa.array(flat)], names=["at", "n"])

    rows = lines.select("lines", "states", "first", "blank", "before").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n")).collect()
    if not rows or not sum(r[1] for r in rows):
        return RoleModel.prior()
    flat = np.zeros(STATES + STATES**2 + STATES * sum(SIZES))
    for at, n in rows:
        flat[at] = n
    emit, i = [], STATES + STATES**2
    for n in SIZES:
        emit.append(flat[i : i + STATES * n].reshape(STATES, n))
        i += STATES * n
    return RoleModel(flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), emit)


def _groups(batches, columns: list[str], by: int):
    """Rows of batches sorted by their first ``by`` columns: (key, rows) for each key."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held and row[:by] != key:
                yield key, held
                held = []
            key = row[:by]
            held.append(row[by:])
    if held:
        yield key, held


def _ends(matrices: DataFrame, kind: str, fan: int) -> DataFrame:
    """id, n, entry, last for each matrix (id, n: its number within the transcript, matrix): the states before it and at its end on the best path."""
    matrices = written(matrices, "matrices")

    def solve(held, entry, last):
        import numpy as np

        ends = cuts([np.frombuffer(x[1]).reshape(STATES, STATES) for x in held], entry, last)
        return [(x[0], ends[k - 1] if k else entry, e) for k, (x, e) in enumerate(zip(held, ends))]

    def dealt(batches, make, names, kinds):
        """Rows of ``make`` for each group of (id, up)."""
        import pyarrow as pa

        batches, done = iter(batches), []
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field("id").type, *kinds]
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names=names)
        given = [c for c in ("n", "matrix", "entry", "last") if c in first.schema.names]
        for (i, up), held in _groups((b for part in ([first], batches) for b in part), ["id", "up", *given], 2):
            done += [(i, *x) for x in make(up, held)]
            if len(done) > 10_000:
                yield out()
                done = []
        if done:
            yield out()

    def down(batches):
        import pyarrow as pa

        yield from dealt(batches, lambda _, held: solve(held, *(held[0][2:] or (None, None))), ["id", "n", "entry", "last"], [pa.int64(), pa.int32(), pa.int32()])

    def up_(batches):
        import numpy as np
        import pyarrow as pa

        yield from dealt(batches, lambda up, held: [(up, product([np.frombuffer(x[1]).reshape(STATES, STATES) for x in held]).tobytes())], ["id", "n", "matrix"], [pa.int64(), pa.binary()])

    grouped = lambda rows: rows.repartition("id", "up").sortWithinPartitions("id", "up", "n")
    placed = matrices.withColumn("up", F.floor(F.col("n") / fan).cast("long"))
    schema = f"id {kind}, n long, entry int, last int"
    if (placed.agg(F.max("up")).first()[0] or 0) == 0:
        return written(grouped(placed).mapInArrow(down, schema), "cuts")
    above = _ends(grouped(placed).mapInArrow(up_, f"id {kind}, n long, matrix binary"), kind, fan).select(F.col("id").alias("i"), F.col("n").alias("u"), "entry", "last")
    given = placed.join(above, F.col("id").eqNullSafe(F.col("i")) & (F.col("up") == F.col("u"))).drop("i", "u")
    return written(grouped(given).mapInArrow(down, schema), "cuts")


def parse(lines: DataFrame, model: RoleModel, fan: int = FAN) -> DataFrame:
    """Recovered turns of ``segments`` (a written table): id, turn_no, role, content, rendered, line_states."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    kind = lines.schema["id"].dataType.simpleString()

    def reduce(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            found = [m.reduce(observed(x, f, b), f).ravel() for x, f, b in zip(*(batch.column(c).to_pylist() for c in ("lines", "first", "blank")))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("seg"), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "seg", "matrix"])

    def trace(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            out = []
            for i, seg, texts, f, b, entry, last in zip(*(batch.column(c).to_pylist() for c in ("id", "seg", "lines", "first", "blank", "entry", "last"))):
                found, turn = pieces(texts, m.trace(observed(texts, f, b), None if f else entry, last)), -1
                for n, (role, starts, text, states) in enumerate(found):
                    turn += starts
                    # the last piece of a segment that has an end state may go on in the next one
                    out.append((i, seg, turn, role, text, states, starts, not starts or last is not None and n == len(found) - 1))
            kinds = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["id", "seg", "turn", "role", "content", "line_states", "starts", "open"])

    schema = f"id {kind}, seg long, turn long, role string, content string, line_states array<int>, starts boolean, open boolean"
    given = ["id", "seg", "lines", "first", "blank", "entry", "last"]
    whole = lines.where("whole").withColumn("entry", F.lit(None).cast("int")).withColumn("last", F.lit(None).cast("int"))
    more = lines.where("NOT whole")
    order = Window.partitionBy("id").orderBy("seg")
    matrices = written(more.mapInArrow(reduce, f"id {kind}, seg long, matrix binary"), "reduced")
    numbered = written(matrices.withColumn("n", (F.row_number().over(order) - 1).cast("long")), "numbered")
    ends = _ends(numbered.select("id", "n", "matrix"), kind, fan).withColumnRenamed("id", "i").withColumnRenamed("n", "k")
    ends = written(numbered.join(ends, F.col("id").eqNullSafe(F.col("i")) & (F.col("n") == F.col("k"))).select("seg", "entry", "last"), "ends")
    cut = written(more.join(ends, "seg").select(*given).mapInArrow(trace, schema), "pieces")
    # turns are numbered through the transcript: how many began in the segments before
    began = cut.groupBy("id", "seg").agg(F.sum(F.col("starts").cast("long")).alias("b"))
    before = began.select("seg", F.coalesce(F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = cut.join(written(before, "before"), "seg").withColumn("turn", F.col("turn") + F.col("before")).drop("before")
    turn = ["id", "turn", "role", "content", "line_states"]
    joined = placed.where("open").groupBy("id", "turn").agg(F.min("role").alias("role"), F.sort_array(F.collect_list(F.struct("seg", "content", "line_states"))).alias("x"))
    joined = joined.select("id", "turn", "role", F.array_join("x.content", "\n").alias("content"), F.flatten("x.line_states").alias("line_states"))
    every = whole.select(*given).mapInArrow(trace, schema).select(*turn).unionByName(placed.where("NOT open").select(*turn)).unionByName(joined)
    text = F.regexp_replace("content", r"^\n+|\n+\z", "")
    return every.select("id", F.col("turn").alias("turn_no"), "role", text.alias("content"), rendered(F.col("role"), text).alias("rendered"), "line_states")


#: Marker styles of plain transcripts, by role (system, user, assistant).
STYLES = (("System: ", "User: ", "Assistant: "), ("[system] ", "[user] ", "[assistant] "), ("Context: ", "Q: ", "A: "), ("Instructions: ", "Human: ", "AI: "))


def plain_transcripts(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as rows of plain transcripts: each conversation in one marker style, one marker in eight left out."""
    style = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % len(STYLES)
    dropped = F.crc32(F.concat_ws("|", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("turn").cast("string")).cast("binary")) % 8 == 0
    mark = F.lit("")
    for i, styles in enumerate(STYLES):
        for role, text in zip(ROLES, styles):
            mark = F.when((style == i) & (F.col("role") == role) & ~dropped, text).otherwise(mark)
    return conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("place"), F.concat(mark, text_or_empty()).alias("text"), "role")


def recovered_turns(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The query's form: learn from conversations whose crc32(conv_id) mod 5 is not 0, recover the turns of all."""
    lines = segments(plain_transcripts(conversations), segment)
    model = fit(lines.where(fold(5, "id") != 0))
    return parse(lines, model).select(F.col("id").alias("conv_id"), (fold(5, "id") == 0).alias("held_out"), "turn_no", "role", F.size("line_states").cast("long").alias("n_lines"), "rendered")
