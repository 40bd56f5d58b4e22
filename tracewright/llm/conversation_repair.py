"""Repairs the turn structure of conversations, solving each distinct signature once.

A row becomes one symbol, of its role's initial and its first fault, and a conversation becomes the string of its symbols. Distinct strings are few however many conversations there are: each is solved once by a memoised recursion for the
cheapest edits that make the roles read (system? (user assistant)+)?, the audits are joined back on the strings, and each row's edits are replayed on it.

A conversation of more than PIECE rows isn't gathered: its rows lie sorted over as many tasks as they need, and it is cut into pieces of at most PIECE rows, which are signatures of their own. What lies behind a
piece counts only through its cost from each of the STATES, so a piece is a small matrix; one walk from the last piece to the first gives the costs behind each, a second walk the state that each begins in, and (piece, costs
behind it) is what is solved once. Both walks read one short row for PIECE turns.

Faults, of which a row's first counts: blank (no [^\\x20\\x09-\\x0D]), duplicate (role and text of an earlier row), truncated (last such character not one of .!?). Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for
blank and duplicate rows), Insert an empty user or assistant turn 3; a truncated row that stays costs 3 more. Ties go to the audit that is least in ASCII order; all edits possible at one place begin with different letters, so costs decide all else.

Defined results: null roles and texts count as one space; null conversation ids are one conversation; rows are ordered by turn, nulls first, equal turns by role and then by the MD5 of their texts; repeated rows are duplicates of the first; roles
of other initials can be reroled or deleted; very long texts are never gathered, only their hashes and last characters; a conversation without rows has no audit; an empty table gives empty results; extra columns of any name are not read.
The digest of a conversation is a running hash, which its rows pass in order through one task without being held there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Workspace, slices, small_side_join

PIECE_BITS = 7
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FINE, CUT, BLANK, TWICE = "suao", "SUAO", "1234", "5678"  # symbols by fault; within each by role: system, user, assistant, another
LEGAL = {"su", "ua", "au"}
STATES = range(4)  # at the start; after a system, user and assistant turn
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FAR = 1 << 30
_ROLE = {c: FINE[k] for group in (FINE, CUT, BLANK, TWICE) for k, c in enumerate(group)}
NAMES = {"u": "user", "a": "assistant"}


@lru_cache(maxsize=1 << 17)
def best(sig: str, state: int, behind: tuple[int, ...] | None, inserts: int = 0) -> tuple[int, int, str]:
    """(cost, state at the end, audit) of the cheapest edits of a signature from a state on. behind: what follows costs so much from each state; None: nothing follows.

    More than two inserts in a row come back to a state that was there before, so they are never cheapest.
    """
    options = []
    wanted = "a" if state == 2 else "u"
    if not sig:
        if behind is not None:
            return behind[state], state, ""
        if state in (0, 3):
            return 0, state, ""
    else:
        symbol, rest = sig[0], sig[1:]
        options.append((DELETE, "D", best(rest, state, behind)))
        if symbol in FINE or symbol in CUT:
            more = TRUNCATED * (symbol in CUT)
            if (to := NEXT.get((state, _ROLE[symbol]))) is not None:
                options.append((more, "K", best(rest, to, behind)))
            options.append((REROLE + more, "R", best(rest, NEXT[state, wanted], behind)))
    if inserts < 2:
        options.append((INSERT, "I", best(sig, NEXT[state, wanted], behind, inserts + 1)))
    if not options:
        return FAR, state, ""
    cost, letter, (after, to, audit) = min(options, key=lambda o: (o[0] + o[2][0], o[1]))
    return min(cost + after, FAR), to, letter + audit


def matrix(sig: str) -> list[int]:
    """Cost of a piece from each state to each state, row by row, and then from each state to the end of a conversation."""
    ends = [tuple(0 if e == k else FAR for e in STATES) for k in STATES]
    return [best(sig, s, end)[0] for s in STATES for end in ends] + [best(sig, s, None)[0] for s in STATES]


def counted(sig: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows and illegal neighbours of a signature."""
    roles = [_ROLE[c] for c in sig]
    n = [sum(c in group for c in sig) for group in (BLANK, TWICE, CUT)]
    return n[0], n[1], n[2], sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def damage(conversations: DataFrame) -> DataFrame:
    """Test damage by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes it a user's; nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    role = F.when(hit == 4, "user").otherwise(name("role"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), hit.alias("hit")).where("hit != 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def conv_key(column: str = "conv_id"):
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


class Repair:
    """The repair of a table of rows (conv_id, turn, role, text); its tables are in a workspace.

    rows: (conv, conv_id, turn, role, text, seq), seq in the order of a conversation's rows; pieces: one row for each piece with its signature, audit and counts; edits: (seq, sub, edit, new_role).
    """

    def __init__(self, rows: DataFrame, tmp: Workspace):
        self.tmp = tmp
        space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
        named = rows.select(conv_key().alias("conv"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
        order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
        dealt = named.withColumn("h", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
        self.rows = tmp.write(dealt, "rows")
        self.pieces = self._solved(self._pieces())
        self.edits = self.pieces.select("sig", "seqs", "start", "audit").mapInArrow(_edits, "seq long, sub int, edit string, new_role string")

    def _pieces(self) -> DataFrame:
        """(conv, piece, long, sig, seqs), seqs the numbers of the piece's rows."""
        trimmed = F.rtrim(F.col("text"), F.lit(BLANKS.decode()))
        initial = F.substring("role", 1, 1)
        role = F.when(initial.isin(*"sua"), initial).otherwise("o")
        same = F.md5(F.concat(F.length("conv"), F.lit(":"), "conv", F.length("role"), F.lit(":"), "role", "h"))
        slim = self.rows.select("conv", "seq", role.alias("role"), (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(*".!?").alias("ended"), same.alias("same"))
        twice = slim.where("NOT blank").groupBy("same").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
        slim = slim.join(twice, "same", "left")
        by = lambda group: F.translate("role", FINE, group)
        symbol = F.when(F.col("blank"), by(BLANK)).when(F.col("seq") > F.col("first"), by(TWICE)).when(~F.col("ended"), by(CUT)).otherwise(F.col("role"))
        signed = slim.select("conv", "seq", symbol.alias("symbol"))
        long = self.rows.groupBy("conv").agg(F.count("*").alias("n")).where(f"n > {1 << PIECE_BITS}").select("conv", F.lit(True).alias("long"))
        cut = small_side_join(signed, long, ["conv"], "left").withColumn("long", F.coalesce("long", F.lit(False)))
        piece = F.when(F.col("long"), F.shiftright("seq", PIECE_BITS)).otherwise(0)
        ordered = cut.groupBy("conv", piece.alias("piece"), "long").agg(F.array_sort(F.collect_list(F.struct("seq", "symbol"))).alias("s"))
        return self.tmp.write(ordered.select("conv", "piece", "long", F.array_join("s.symbol", "").alias("sig"), F.col("s.seq").alias("seqs")), "pieces")

    def _solved(self, pieces: DataFrame) -> DataFrame:
        """The pieces with the costs behind them, the state that they begin in, and their solution."""
        alone = pieces.where("NOT long").select("conv", "piece", "sig", "seqs", F.lit("").alias("behind"))
        cut = pieces.where("long")
        many = not cut.isEmpty()
        if many:
            known = cut.select("sig").distinct().mapInArrow(_matrices, "sig string, costs array<int>")
            back = cut.select("conv", "piece", "sig").join(known, "sig").repartition("conv").sortWithinPartitions("conv", F.desc("piece"))
            ends = back.select("conv", "piece", "costs").mapInArrow(_backward, "conv string, piece long, behind string")
            cut = self.tmp.write(cut.select("conv", "piece", "sig", "seqs").join(ends, ["conv", "piece"]), "cut")
        todo = alone.select("sig", "behind") if not many else alone.select("sig", "behind").unionByName(cut.select("sig", "behind"))
        answers = self.tmp.write(todo.distinct().mapInArrow(_answers, ANSWERS), "answers")
        placed = alone.select("conv", "piece", "sig", "seqs", "behind", F.lit(0).alias("start"), F.lit(0).alias("seam"))
        if many:
            moves = answers.groupBy("sig", "behind").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "to"))), lambda x: x["to"]).alias("to"))
            ahead = cut.join(moves, ["sig", "behind"]).select("conv", "piece", "sig", "to").repartition("conv").sortWithinPartitions("conv", "piece")
            starts = ahead.mapInArrow(_forward, "conv string, piece long, start int, seam int")
            placed = placed.unionByName(cut.join(starts, ["conv", "piece"]).select(*placed.columns))
        return self.tmp.write(placed.join(answers, ["sig", "behind", "start"]), "solved")

    def summary(self) -> DataFrame:
        """(conv, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
        add = lambda c: F.sum(c).cast("long").alias(c)
        told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "").alias("audit")
        return self.pieces.groupBy("conv").agg(add("blank"), add("duplicate"), add("truncated"), F.sum(F.col("illegal") + F.col("seam")).cast("long").alias("illegal"), add("cost"), told)

    def gaps(self) -> DataFrame:
        """(conv, gaps): turns that are missing between the first and the last."""
        turns = self.rows.select("conv", "turn").distinct().groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count("turn").alias("n"))
        return turns.select("conv", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))

    def repaired(self) -> DataFrame:
        """(conv, conv_id, turn, seq, sub, edit, role, text): the rows after repair in the order of (seq, sub); inserted ones have the turn that they stand at."""
        met = self.rows.join(self.edits.where("edit != 'D'"), "seq")
        return met.select("conv", "conv_id", "turn", "seq", "sub", "edit", F.coalesce("new_role", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))

    def digests(self) -> DataFrame:
        """(conv, digest): SHA-256 of the repaired rows as role:text, joined by newlines."""
        ordered = self.repaired().select("conv", "seq", "sub", "role", "text").repartition("conv").sortWithinPartitions("conv", "seq", "sub")
        return ordered.select("conv", "role", "text").mapInArrow(_digests, "conv string, digest string")


ANSWERS = "sig string, behind string, start int, to int, cost int, audit string, blank int, duplicate int, truncated int, illegal int"


def _told(costs: list[int]) -> str:
    """Costs behind a piece, less the least of them, which leaves choices as they are and makes few different ones."""
    return ",".join(str(min(c, FAR) - min(costs)) for c in costs)


def _spent(sig: str, audit: str) -> int:
    """Cost of an audit of a signature."""
    rows, total = iter(sig), 0
    for edit in audit:
        symbol = None if edit == "I" else next(rows)
        total += {"I": INSERT, "D": DELETE, "R": REROLE, "K": 0}[edit] + (TRUNCATED if edit in "KR" and symbol in CUT else 0)
    return total


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("sig"), pa.array([matrix(s) for s in b.column("sig").to_pylist()], pa.list_(pa.int32()))], ["sig", "costs"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 4096):
        out = []
        for sig, behind in zip(b.column("sig").to_pylist(), b.column("behind").to_pylist(), strict=True):
            costs, n = tuple(map(int, behind.split(","))) if behind else None, counted(sig)
            for start in STATES:
                _, to, audit = best(sig, start, costs)
                out.append((sig, behind, start, to, _spent(sig, audit), audit, *n))
        names = [c.split()[0] for c in ANSWERS.split(", ")]
        types = [pa.string() if " string" in c else pa.int32() for c in ANSWERS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks each conversation's pieces from the last to the first and gives the costs behind each."""
    at, costs = None, None
    for b in batches:
        out = []
        for conv, m in zip(b.column("conv").to_pylist(), b.column("costs").to_pylist(), strict=True):
            if conv != at:
                at, costs = conv, None
            out.append("" if costs is None else _told(costs))
            costs = m[16:] if costs is None else [min(m[4 * s + e] + costs[e] for e in STATES) for s in STATES]
            costs = [min(c - min(costs), FAR) for c in costs]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("piece"), pa.array(out, pa.string())], ["conv", "piece", "behind"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks each conversation's pieces from the first on and gives the state each begins in, and whether its first row is illegal after the piece before."""
    at, state, last = None, 0, ""
    for b in batches:
        starts, seams = [], []
        for conv, sig, to in zip(*(b.column(c).to_pylist() for c in ("conv", "sig", "to")), strict=True):
            if conv != at:
                at, state, last = conv, 0, ""
            starts.append(state)
            seams.append(int(bool(last) and last + _ROLE[sig[0]] not in LEGAL))
            state, last = to[state], _ROLE[sig[-1]]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("piece"), pa.array(starts, pa.int32()), pa.array(seams, pa.int32())], ["conv", "piece", "start", "seam"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of audits, each with the row that it stands at; inserts stand before the next row, or after the last."""
    for b in slices(batches, 1024):
        out = []
        for sig, seqs, state, audit in zip(*(b.column(c).to_pylist() for c in ("sig", "seqs", "start", "audit")), strict=True):
            row, sub = 0, 0
            for edit in audit:
                wanted = "a" if state == 2 else "u"
                after = row == len(seqs)
                out.append((seqs[row - after], sub, edit, NAMES[wanted] if edit in "IR" else None))
                if edit in "IR":
                    state = NEXT[state, wanted]
                elif edit == "K":
                    state = NEXT[state, _ROLE[sig[row]]]
                sub += 1
                if edit != "I":
                    row += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], ["seq", "sub", "edit", "new_role"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, running = None, None
    for b in slices(batches, 1024):
        done = []
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if conv != at:
                if running is not None:
                    done.append((at, running.hexdigest()))
                at, running = conv, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        yield _pairs(done)
    if running is not None:
        yield _pairs([(at, running.hexdigest())])


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["conv", "digest"])


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, position, edit, role, text): the repaired rows of each conversation by position, with the edit each comes from."""
    with Workspace(rows.sparkSession, "repair") as tmp:
        out = Repair(rows, tmp).repaired()
        return tmp.write(out.select("conv_id", "turn", F.struct("seq", "sub").alias("position"), "edit", "role", "text"), "repaired", keep=True)


def audit_conversations(rows: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each conv_id of every: its faults, gaps, the cheapest edits with their cost, and the digest of the repaired rows; zeros and the digest of nothing where rows has none."""
    ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", conv_key())
    with Workspace(rows.sparkSession, "repair") as tmp:
        r = Repair(rows, tmp)
        out = ids.join(r.gaps(), "conv", "left").join(r.summary(), "conv", "left").join(r.digests(), "conv", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        out = out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
        return tmp.write(out, "audits", keep=True)
