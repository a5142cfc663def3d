"""Repair of the turn structure of conversations: faults, the cheapest edits and what they leave.

Rows are sorted by range of (conversation, turn), so one conversation may be spread over many tasks; each task walks its rows
in order. A short conversation that lies inside one task is aligned there (``turn_alignment``). All others are cut into
segments: each segment gets its cheapest script for every pair of states before and after it, the scripts are chained per
conversation by least cost, and the chosen ones are applied to the stored segments. The chain is exact: two scripts of
one segment with equal cost never are the beginning of each other, so the ASCII order of the whole is that of its parts.

Defined results: a NULL role or text is one space. Rows of equal turn stand by role and text; NULL turns stand first. Equal
rows are repeats of each other. Conversations whose rows are all dropped give zeros and an empty audit. NULL is a
conversation id like any other. Only the four named columns are read, so no further column can clash. No rows give no rows.
The digest of a conversation's whole text is a chain by nature: the segments of one conversation are hashed in order by one
task, which holds one segment at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from invoicelens.session import materialise

from .batches import ship_package, slices
from .bounded import Memo
from .turn_alignment import ACCEPTED, STATES, apply_script, best_script, script_table

BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Longer strings of turns are aligned in parts of so many.
PART = 12
#: A segment ends at so many turns or characters.
SEGMENT_TURNS, SEGMENT_CHARS = 240, 1 << 20
_WAYS = [(a, b) for a in range(len(STATES)) for b in range(len(STATES))]

_TURNS = "repaired array<struct<edit: string, role: string, text: string>>"
_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_RESULT = f"task int, place int, {_TURNS}, closes boolean, {_COUNTS}, repaired_sha256 string"
_SEGMENT = ("n_turns bigint, first_turn bigint, last_turn bigint, first_role string, last_role string, "
            "costs array<bigint>, scripts array<string>, kept array<struct<role: string, text: string>>")
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) as a checksum of conversation and turn damages them.

    A dropped row stays as one without turn, role and text, with 0 copies.
    """
    word = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, "turn")]
    way = F.crc32(F.concat(word[0], F.lit(":"), word[1])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    marked = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), way.alias("way"),
        F.when(way == 4, "user").otherwise(role).alias("role"),
        F.when(way == 1, "").when(way == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"))
    stays = F.col("way") != 0
    return marked.select(
        "conv_id", *[F.when(stays, F.col(c)).alias(c) for c in ("turn", "role", "text")],
        F.when(F.col("way") == 0, 0).when(F.col("way") == 3, 2).otherwise(1).alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """One row per kind of row, sorted by conversation and turn; ``again`` where role and text came in an earlier turn."""
    kinds = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    kinds = kinds.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    repeated = (kinds.filter("copies > 0").groupBy("conv_id", "said")
                .agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                .select(F.col("conv_id").alias("of"), F.col("said").alias("same"), "first"))
    joined = kinds.join(repeated, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("same")), "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    keys = ["conv_id", "turn", "role", "said"]
    return (joined.select(*keys, "text", "copies", again.alias("again"))
            .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("said"))


def combine(first: list, second: list) -> list:
    """The table of cheapest scripts of two strings of turns, one after the other."""
    out = []
    for start, end in _WAYS:
        best = None
        for by in range(len(STATES)):
            a, b = first[start * len(STATES) + by], second[by * len(STATES) + end]
            if a is None or b is None or (best is not None and a[0] + b[0] > best[0]):
                continue
            joined = (a[0] + b[0], a[1] + b[1])
            best = joined if best is None or joined < best else best
        out.append(best)
    return out


class Aligner:
    """Tables of scripts, with those of short strings kept."""

    def __init__(self):
        self._short = Memo(script_table, 20_000)
        self._whole = Memo(lambda turns: min(s for s in (best_script(turns, "", end) for end in ACCEPTED) if s is not None), 50_000)

    def table(self, turns: str) -> list:
        if len(turns) <= PART:
            return self._short[turns]
        half = (len(turns) // PART + 1) // 2 * PART
        return combine(self.table(turns[:half]), self.table(turns[half:]))

    def whole(self, turns: str) -> tuple[int, str]:
        """The cheapest script of a conversation of its own."""
        if len(turns) <= 2 * PART:
            return self._whole[turns]
        return min(self.table(turns)[STATES.index(end)] for end in ACCEPTED if self.table(turns)[STATES.index(end)] is not None)


class _Segment:
    """Consecutive turns of one conversation."""

    def __init__(self, conv):
        self.conv, self.letters, self.kept, self.chars = conv, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = self.rows = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn, role: str, text: str, again: bool) -> None:
        said = text.rstrip(BLANK)
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not said:
            self.blank += 1
            letter = "D"
        elif again:
            self.duplicate += 1
            letter = "D"
        elif said[-1] not in ENDS:
            self.truncated += 1
            letter = letter.upper()
        self.letters.append(letter)
        if letter != "D":
            self.kept.append((role, text))
            self.chars += len(role) + len(text)
        if self.rows and self.last_role + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if not self.rows:
            self.first_role = role[:1]
        self.last_role = role[:1]
        self.rows += 1
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    @property
    def full(self) -> bool:
        return self.rows >= SEGMENT_TURNS or self.chars >= SEGMENT_CHARS

    @property
    def string(self) -> str:
        return "".join(self.letters)

    def counts(self) -> dict:
        return {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def _gaps(first, last, n_turns: int) -> int:
    return 0 if first is None else last - first + 1 - n_turns


def edited(script: str, letters: str, start: str, kept: list[tuple[str, str]]) -> tuple[list[tuple[str, str, str]], str]:
    """The turns that ``script`` leaves, given the turns that may stay; those marked ``D`` have no text any more."""
    rest = iter(kept)
    return apply_script(script, start, [("", "") if letter == "D" else next(rest) for letter in letters])


def _digest(turns: list[tuple[str, str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for _, role, text in turns).encode("utf-8", "surrogatepass")


class _Out:
    """Rows to come, given out as batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: dict, chars: int = 0) -> None:
        self.rows.append(row)
        self.chars += chars + 200

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or self.chars >= 4 << 20):
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows, self.chars = [], 0


def _rows(batches: Iterator[pa.RecordBatch], big: str | None) -> Iterator[dict]:
    for batch in batches:
        for piece in slices(batch, big) if big else [batch]:
            yield from piece.to_pylist()


def _as_structs(turns: list[tuple[str, str, str]]) -> list[dict]:
    return [{"edit": e, "role": r, "text": t} for e, r, t in turns]


def _walk(rows: DataFrame, with_turns: bool) -> DataFrame:
    """Finished conversations (``closes``) and segments of the others, by one walk over the sorted rows of each task."""
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(f"{_RESULT}, {_SEGMENT}, letters string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        task, out, aligner, place = TaskContext.get().partitionId(), _Out(arrow), Aligner(), 0
        now, opened = None, True  # the first conversation of a task may have begun in the task before

        def segment(s: _Segment) -> None:
            table = aligner.table(s.string)
            out.add({"conv_id": s.conv, "task": task, "place": place, "closes": False, **s.counts(),
                     "n_turns": s.n_turns, "first_turn": s.first_turn, "last_turn": s.last_turn,
                     "first_role": s.first_role if s.rows else None, "last_role": s.last_role if s.rows else None,
                     "costs": [t and t[0] for t in table], "scripts": [t and t[1] for t in table],
                     "kept": [{"role": r, "text": t} for r, t in s.kept], "letters": s.string}, s.chars)

        def finished(s: _Segment) -> None:
            cost, audit = aligner.whole(s.string)
            turns, _ = edited(audit, s.string, "", s.kept)
            out.add({"conv_id": s.conv, "task": task, "place": place, "closes": True, **s.counts(), "cost": cost, "audit": audit,
                     "gaps": _gaps(s.first_turn, s.last_turn, s.n_turns),
                     "repaired": _as_structs(turns) if with_turns else None,
                     "repaired_sha256": hashlib.sha256(_digest(turns)).hexdigest()}, s.chars if with_turns else 0)

        for row in _rows(batches, "text"):
            if now is not None and now.conv != row["conv_id"]:
                (segment if opened else finished)(now)
                now, opened, place = None, False, place + 1
            now = now or _Segment(row["conv_id"])
            for copy in range(row["copies"]):
                if now.full:
                    segment(now)
                    now, opened, place = _Segment(row["conv_id"]), True, place + 1
                    yield from out.batches()
                now.add(row["turn"], row["role"], row["text"], row["again"] or copy > 0)
            yield from out.batches()
        if now is not None:
            segment(now)
        yield from out.batches(last=True)

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema)


class _Chain:
    """The cheapest scripts of one conversation up to its last segment, for each state they may end in.

    A path is (cost, path before, script, state before); only the paths that can still win are held.
    """

    def __init__(self):
        self.paths: list = [(0, None, "", 0), None, None, None]
        self.at: list[dict] = []

    def add(self, row: dict) -> None:
        new = []
        for end in range(len(STATES)):
            best = None
            for start, path in enumerate(self.paths):
                cost = row["costs"][start * len(STATES) + end]
                if path is None or cost is None:
                    continue
                made = (path[0] + cost, path, row["scripts"][start * len(STATES) + end], start)
                if best is None or made[0] < best[0] or (made[0] == best[0] and _before(made, best)):
                    best = made
            new.append(best)
        self.paths = new
        self.at.append({k: v for k, v in row.items() if k not in ("costs", "scripts")})

    def choices(self) -> list[dict]:
        """The chosen script and the state before it for each segment; the last one holds what counts for all."""
        path = None
        for state in ACCEPTED:
            other = self.paths[STATES.index(state)]
            if other is not None and (path is None or other[0] < path[0] or (other[0] == path[0] and _before(other, path))):
                path = other
        cost, back = path[0], []
        while path[1] is not None:
            back.append(path[2:])
            path = path[1]
        rows = [{"conv_id": s["conv_id"], "task": s["task"], "place": s["place"], "script": script, "state": STATES[state], "closes": False}
                for s, (script, state) in zip(self.at, reversed(back))]
        sums = {k: sum(s[k] for s in self.at) for k in ("blank", "duplicate", "truncated", "illegal", "n_turns")}
        first = last = ended = None
        for s in self.at:
            if s["first_role"] is not None:
                if ended is not None and ended + s["first_role"] not in ("su", "ua", "au"):
                    sums["illegal"] += 1
                ended = s["last_role"]
            if s["first_turn"] is not None:
                sums["n_turns"] -= s["first_turn"] == last
                first, last = s["first_turn"] if first is None else first, s["last_turn"]
        gaps = _gaps(first, last, sums.pop("n_turns"))
        rows[-1].update(closes=True, cost=cost, audit="".join(r["script"] for r in rows), gaps=gaps, **sums)
        return rows


def _before(a: tuple, b: tuple) -> bool:
    """Whether the whole script of path ``a`` comes before that of ``b``: read back to where both meet."""
    left, right = [], []
    while a is not b and a is not None:
        left.append(a[2])
        right.append(b[2])
        a, b = a[1], b[1]
    return "".join(reversed(left)) < "".join(reversed(right))


def _chained(segments: DataFrame) -> DataFrame:
    """For each segment the script that the cheapest edits of its conversation use there."""
    light = segments.select("conv_id", "task", "place", "blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn",
                            "last_turn", "first_role", "last_role", "costs", "scripts")
    schema = StructType([segments.schema["conv_id"], *StructType.fromDDL(
        f"task int, place int, script string, state string, closes boolean, {_COUNTS}").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        out, chain, conv, some = _Out(arrow), _Chain(), None, False
        for row in _rows(batches, None):
            if some and row["conv_id"] != conv:
                for made in chain.choices():
                    out.add(made, len(made["script"]))
                chain = _Chain()
                yield from out.batches()
            conv, some = row["conv_id"], True
            chain.add(row)
        for made in chain.choices() if some else []:
            out.add(made, len(made["script"]))
        yield from out.batches(last=True)

    return light.repartition("conv_id").sortWithinPartitions("conv_id", "task", "place").mapInArrow(run, schema)


def _applied(segments: DataFrame, with_turns: bool) -> DataFrame:
    """The chosen scripts applied to the stored segments, with a running digest over those of one conversation."""
    stored = segments.select("task", "place", "letters", "kept")
    chosen = _chained(segments).join(stored, ["task", "place"]).select(
        "conv_id", "task", "place", "script", "state", "closes", *[f.name for f in StructType.fromDDL(_COUNTS)], "letters", "kept")
    schema = StructType([segments.schema["conv_id"], *StructType.fromDDL(_RESULT).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        out, sha, any_turn = _Out(arrow), hashlib.sha256(), False
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            turns, _ = edited(row["script"], row.pop("letters"), row.pop("state"), [(k["role"], k["text"]) for k in row.pop("kept")])
            if turns:
                sha.update((b"\n" if any_turn else b"") + _digest(turns))
                any_turn = True
            made = {**{k: v for k, v in row.items() if k != "script"}, "repaired": _as_structs(turns) if with_turns else None}
            if row["closes"]:
                made["repaired_sha256"] = sha.hexdigest()
                sha, any_turn = hashlib.sha256(), False
            out.add(made, sum(len(t) for _, _, t in turns) if with_turns else len(row["script"]))
            yield from out.batches()
        yield from out.batches(last=True)

    return chosen.repartition("conv_id").sortWithinPartitions("conv_id", "task", "place").mapInArrow(run, schema)


def repair(rows: DataFrame, with_turns: bool = False) -> DataFrame:
    """Pieces of repaired conversations, in order of (task, place); the piece that ``closes`` one holds its counts.

    ``rows`` are as ``damaged`` gives them: conv_id, turn, role, text, copies.
    """
    walked = materialise(_walk(_ordered(rows), with_turns))
    names = ["conv_id", *[f.name for f in StructType.fromDDL(_RESULT)]]
    parts = walked.filter("letters IS NOT NULL")
    return walked.filter("letters IS NULL").select(*names).unionByName(_applied(parts, with_turns).select(*names))


def whole(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as they are, ready for ``repair``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role, text, F.lit(1).alias("copies"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """One row per turn that the repair leaves: conv_id, task, place, at (ordered by these three), edit, role, text."""
    return repair(rows, with_turns=True).select("conv_id", "task", "place", F.posexplode("repaired").alias("at", "turn")).select(
        "conv_id", "task", "place", "at", "turn.*")


def audit_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults found, cost and audit of the cheapest edits, digest of what they leave."""
    return repair(rows).filter("closes").select("conv_id", *RESULT)
