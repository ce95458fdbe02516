"""Conversations repaired into ``(s?(ua)+)?`` by their cheapest edits.

A turn is kept (K, free), given the role that fits (R, 3), or deleted (D, 4);
an empty turn can be inserted anywhere (I, 3).  Blank turns and repeats must
go; a truncated turn that stays adds 3.  Of the cheapest edits the one whose
letters are least in ASCII order counts.

A path of edits is one integer.  Its high digits are the cost; below them
stand the letters, three bits each, from the left in a field of fixed width,
padded with zeros at the end.  So the least integer is the cheapest path, and
among those the least by letters.  Two paths of one cost to one state never
have letters of which one begins the other (the rest would be insertions
only, which cost), so a least integer for each state is all that a path
needs.

Rows are sorted by range, so that a long conversation spreads over partitions.
A conversation inside one partition is repaired there.  A longer one is cut
into pieces of bounded size; each piece gives the least integers from every
state to every state, and these are put together 64 at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import saved, small_batches

SPACE = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
# Largest piece of a conversation: turns, and bytes of text unless one text is longer.
PIECE_ROWS, PIECE_BYTES = 1024, 4 << 20
FAN_IN = 64
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = " DIKR"
# States: nothing yet, after s, after u, after a.  What may come next.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
# The one role of an inserted or renamed turn in each state.
FITS = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
# Insertions that finish a conversation from each state.
CLOSING = ((0, ""), (6, "II"), (3, "I"), (0, ""))
MEMO = 50_000


class Path(NamedTuple):
    weight: int
    letters: int


def routes(codes: str, start: int) -> list[tuple[int, str] | None]:
    """The cheapest (cost, letters) from ``start`` to each state.

    ``codes`` has a character for each turn: ``s``, ``u``, ``a`` or ``o`` by
    role, in upper case where truncated, and ``x`` for turns that must go.
    """
    places = 3 * len(codes)  # at most two insertions and a letter for each turn
    width = 3 * places

    def edit(path: Path, letter: str, cost: int) -> Path:
        return Path(path.weight + (cost << width) + (DIGITS[letter] << (width - 3 * path.letters - 3)), path.letters + 1)

    def offer(best: list[Path | None], state: int, path: Path) -> None:
        if best[state] is None or path.weight < best[state].weight:
            best[state] = path

    front: list[Path | None] = [None] * 4
    front[start] = Path(0, 0)
    for code in codes:
        for _ in range(2):
            for state, path in enumerate(list(front)):
                if path is not None:
                    offer(front, NEXT[state][FITS[state]], edit(path, "I", 3))
        after: list[Path | None] = [None] * 4
        role, extra = code.lower(), 3 if code.isupper() else 0
        for state, path in enumerate(front):
            if path is None:
                continue
            offer(after, state, edit(path, "D", 4))
            if role != "x":
                offer(after, NEXT[state][FITS[state]], edit(path, "R", 3 + extra))
                if role in NEXT[state]:
                    offer(after, NEXT[state][role], edit(path, "K", extra))
        front = after
    found: list[tuple[int, str] | None] = []
    for path in front:
        if path is None:
            found.append(None)
            continue
        digits = path.weight & ((1 << width) - 1)
        # three bits are one octal digit
        text = f"{digits:0{places}o}"[:path.letters] if path.letters else ""
        found.append((path.weight >> width, text.translate({ord(str(n)): letter for n, letter in enumerate(LETTERS)})))
    return found


def best(candidates: list[tuple[int, str]]) -> tuple[int, str]:
    """The least as one integer: cost above letters padded with zeros."""
    places = max(len(letters) for _, letters in candidates)

    def weight(candidate: tuple[int, str]) -> int:
        cost, letters = candidate
        digits = "".join(str(DIGITS[x]) for x in letters).ljust(places, "0")
        return (cost << (3 * places)) + int(digits or "0", 8)

    return min(candidates, key=weight)


def finish(row: list[tuple[int, str] | None]) -> tuple[int, str]:
    """The cheapest end of a conversation that is in these states."""
    return best([(cost + CLOSING[s][0], letters + CLOSING[s][1]) for s, found in enumerate(row) if found is not None for cost, letters in [found]])


def chained(one: list, two: list) -> list:
    """Routes through two pieces, one after the other."""
    out = []
    for start in range(4):
        row: list = []
        for end in range(4):
            ways = [(a[0] + b[0], a[1] + b[1]) for mid in range(4) if (a := one[start][mid]) and (b := two[mid][end])]
            row.append(best(ways) if ways else None)
        out.append(row)
    return out


def replay(codes: str, letters: str, state: int = 0) -> Iterator[tuple[int | None, str, str | None]]:
    """For each letter: the turn it takes (None: inserted), the letter, and
    the new role if it has one; moves through the states."""
    at = 0
    for letter in letters:
        turn = None
        if letter != "I":
            turn, at = at, at + 1
        role = None
        if letter in "IR":
            role = ROLES[FITS[state]]
            state = NEXT[state][FITS[state]]
        elif letter == "K":
            state = NEXT[state][codes[turn].lower()]
        yield turn, letter, role


def state_after(codes: str, letters: str, state: int) -> int:
    at = 0
    for letter in letters:
        if letter in "IR":
            state = NEXT[state][FITS[state]]
        elif letter == "K":
            state = NEXT[state][codes[at].lower()]
        at += letter != "I"
    return state


def repaired(codes: str, letters: str, roles: list[str], texts: list[str], state: int = 0) -> list[dict]:
    return [
        {"edit": letter, "role": role or roles[turn], "text": "" if turn is None else texts[turn]}
        for turn, letter, role in replay(codes, letters, state) if letter != "D"
    ]


def illegal_pair(before: str, after: str) -> bool:
    return before.lower() + after.lower() not in ("su", "ua", "au")


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


class Piece:
    """Turns of one conversation in order, and what is counted of them."""

    def __init__(self, seen: set[bytes] = frozenset()):
        self.seen, self.codes, self.size = set(seen), [], 0
        self.raw: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.digests: list[bytes] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = None

    def add(self, turn: int | None, code: str, digest: bytes) -> None:
        """``code`` says role and fault, ``b`` before it for a blank text."""
        role = code[-1]
        if self.raw:
            self.counts["illegal"] += illegal_pair(self.raw[-1][-1], role)
        self.raw.append(code)
        self.digests.append(digest)
        if code[0] == "b":
            self.counts["blank"] += 1
            self.codes.append("x")
        elif digest in self.seen:
            self.counts["duplicate"] += 1
            self.codes.append("x")
        else:
            self.counts["truncated"] += role.isupper()
            self.codes.append(role)
        self.seen.add(digest)
        if turn is not None:
            self.counts["turns"] += self.high is None or turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]


_ROWS = "array<struct<edit:string,role:string,text:string>>"
_REPORT = "struct<rows:bigint,gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"
_SORTED = (
    f"conv_id bigint, part int, piece int, report {_REPORT}, repaired {_ROWS}, "
    "turns array<bigint>, codes array<string>, digests array<binary>, roles array<string>, texts array<string>"
)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _walk(schema: pa.Schema):
    """Rows sorted by conversation and place to repaired conversations, or
    pieces of those that may go on in another partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        memo: dict[str, tuple[int, str]] = {}
        out: list[dict] = []
        size = 0
        current, number, first, turns = object(), 0, True, []
        piece = Piece()

        def plan(codes: str) -> tuple[int, str]:
            if codes not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[codes] = finish(routes(codes, 0))
            return memo[codes]

        def close(ended: bool) -> None:
            nonlocal size
            if not piece.raw:
                return
            row = {"conv_id": current, "part": part, "piece": number}
            if ended and number == 0 and not first:
                codes = "".join(piece.codes)
                cost, audit = plan(codes)
                counts = {k: piece.counts[k] for k in COUNTS[:4]}
                row["report"] = {"rows": len(codes), "gaps": piece.gaps(), **counts, "cost": cost, "audit": audit}
                row["repaired"] = repaired(codes, audit, piece.roles, piece.texts)
            else:
                row |= {"turns": turns, "codes": piece.raw, "digests": piece.digests, "roles": piece.roles, "texts": piece.texts}
            out.append(row)
            size += piece.size + 1000

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for conv, turn, role, text, code, digest in zip(*columns):
                if conv != current or not (piece.raw or number):
                    close(True)
                    first = not piece.raw and not number  # nothing came before
                    current, number, piece, turns = conv, 0, Piece(), []
                elif len(piece.raw) >= PIECE_ROWS or piece.size + len(text) > PIECE_BYTES:
                    close(False)
                    number, piece, turns = number + 1, Piece(), []
                piece.add(turn, code, digest)
                piece.roles.append(role)
                piece.texts.append(text)
                turns.append(turn)
                piece.size += len(text) + 64
                if size > PIECE_BYTES:
                    yield from pa.Table.from_pylist(out, schema=schema).to_batches()
                    out, size = [], 0
        close(False)
        if out:
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()

    return run


_ROUTE = "array<struct<from:int,to:int,cost:bigint,letters:string>>"
_SUMMARY = (
    f"conv_id bigint, place bigint, codes string, firsts string, lasts string, low bigint, high bigint, "
    f"{', '.join(f'{c} bigint' for c in COUNTS)}, routes {_ROUTE}"
)


def _packed(matrix: list) -> list[dict]:
    return [{"from": s, "to": t, "cost": x[0], "letters": x[1]} for s, row in enumerate(matrix) for t, x in enumerate(row) if x]


def _unpacked(found: list[dict]) -> list:
    matrix: list = [[None] * 4 for _ in range(4)]
    for x in found:
        matrix[x["from"]][x["to"]] = (x["cost"], x["letters"])
    return matrix


def _summaries(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                piece = Piece(set(row["seen"] or []))
                for turn, code, digest in zip(row["turns"], row["codes"], row["digests"]):
                    piece.add(turn, code, digest)
                codes = "".join(piece.codes)
                yield from pa.Table.from_pylist([{
                    "conv_id": row["conv_id"], "place": row["place"], "codes": codes, "firsts": piece.raw[0][-1], "lasts": piece.raw[-1][-1],
                    "low": piece.low, "high": piece.high, **piece.counts, "routes": _packed([routes(codes, s) for s in range(4)]),
                }], schema=schema).to_batches()

    return run


def _joined(schema: pa.Schema):
    """At most ``FAN_IN`` neighbouring summaries as one."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        total, matrix = rows[0], _unpacked(rows[0]["routes"])
        codes = [total["codes"]]
        for row in rows[1:]:
            for name in COUNTS:
                total[name] += row[name]
            total["illegal"] += illegal_pair(total["lasts"], row["firsts"])
            total["turns"] -= row["low"] is not None and row["low"] == total["high"]
            total["lasts"] = row["lasts"]
            total["low"] = row["low"] if total["low"] is None else total["low"]
            total["high"] = total["high"] if row["high"] is None else row["high"]
            codes.append(row["codes"])
            matrix = chained(matrix, _unpacked(row["routes"]))
        total |= {"codes": "".join(codes), "routes": _packed(matrix), "place": total["place"] // FAN_IN}
        return pa.Table.from_pylist([total], schema=schema)

    return run


_PLAN = f"conv_id bigint, place bigint, letters string, codes string, state int, report {_REPORT}"


def _dealt(schema: pa.Schema):
    """The edits of whole conversations, back to their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cost, audit = finish(_unpacked(row["routes"])[0])
                gaps = 0 if row["low"] is None else row["high"] - row["low"] + 1 - row["turns"]
                report = {"rows": len(row["codes"]), "gaps": gaps, **{k: row[k] for k in COUNTS[:4]}, "cost": cost, "audit": audit}
                at = turn = state = 0
                for place, size in enumerate(row["sizes"]):
                    start, left = at, size
                    while at < len(audit) and (left or place == len(row["sizes"]) - 1):
                        left -= audit[at] != "I"
                        at += 1
                    codes, letters = row["codes"][turn:turn + size], audit[start:at]
                    yield from pa.Table.from_pylist([{
                        "conv_id": row["conv_id"], "place": place, "letters": letters, "codes": codes, "state": state, "report": None if place else report,
                    }], schema=schema).to_batches()
                    state, turn = state_after(codes, letters, state), turn + size

    return run


def _applied(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from pa.Table.from_pylist([{
                    "conv_id": row["conv_id"], "piece": row["place"], "report": row["report"],
                    "repaired": repaired(row["codes"], row["letters"], row["roles"], row["texts"], row["state"]),
                }], schema=schema).to_batches()

    return run


def coded(role: Column, text: Column) -> Column:
    """Role and fault of a turn: the role's letter (``o``: another role), in
    upper case where the text breaks off, and after ``b`` where it is blank."""
    body = F.rtrim(text, F.lit(SPACE))
    letter = F.substring(role, 1, 1)
    letter = F.when(letter.isin("s", "u", "a"), letter).otherwise("o")
    return F.when(body == "", F.concat(F.lit("b"), letter)).when(F.right(body, F.lit(1)).isin(*ENDINGS), letter).otherwise(F.upper(letter))


def repair(turns: DataFrame) -> DataFrame:
    """Repaired conversations of ``turns`` (conv_id, turn, role, text; more
    columns are ignored).

    Returns ``conv_id, piece, pieces, report, repaired``: the turns of a
    conversation after its edits (edit, role, text), in pieces of bounded size
    numbered from 0 (nearly always one), with a report in piece 0: rows, gaps,
    blank, duplicate, truncated, illegal, cost, audit.

    Turns are taken by number, nulls first; turns of one number by role and
    digest of the text.  A null role or text is one space, a null conv_id a
    conversation of its own.  Repeated rows count as repeats of a turn.  A long
    text stays in one piece.  An empty table gives no rows.
    """
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    rows = rows.select("conv_id", "turn", "role", "text", coded(F.col("role"), F.col("text")).alias("code"), digest.alias("digest"))
    place = ["conv_id", "turn", "role", "digest"]
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    done = saved(ordered.mapInArrow(_walk(_arrow(_SORTED)), _SORTED), "repaired")
    whole = done.filter("report IS NOT NULL").select("conv_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "report", "repaired")

    cut = done.filter("report IS NULL")
    by_place = Window.partitionBy("conv_id").orderBy("part", "piece")
    cut = cut.withColumn("place", F.row_number().over(by_place).cast("long") - 1)
    # Repeats of a turn of an earlier piece.
    digests = cut.select("conv_id", "place", F.explode(F.array_distinct("digests")).alias("digest"))
    firsts = digests.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last")
    same = F.col("d.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("d.digest") == F.col("f.digest"))
    seen = (
        digests.alias("d").join(firsts.alias("f"), same).filter("d.place > f.first")
        .groupBy("d.conv_id", "d.place").agg(F.collect_list("d.digest").alias("seen"))
    )
    slim = cut.select("conv_id", "place", "turns", "codes", "digests")
    same = F.col("c.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("c.place") == F.col("s.place"))
    slim = slim.alias("c").join(seen.alias("s"), same, "left").select("c.*", "s.seen")
    summaries = saved(slim.mapInArrow(_summaries(_arrow(_SUMMARY)), _SUMMARY), "summaries")
    sizes = summaries.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", F.length("codes").alias("size")))), lambda x: x["size"]).alias("sizes"),
        F.count("*").alias("pieces"))
    most = summaries.agg(F.max("place")).first()[0] or 0
    joined = summaries
    while True:
        groups = joined.groupBy("conv_id", F.floor(F.col("place") / FAN_IN).alias("group"))
        joined = groups.applyInArrow(_joined(_arrow(_SUMMARY)), _SUMMARY)
        most //= FAN_IN
        if not most:
            break
        joined = saved(joined, "summaries")
    sized = joined.alias("j").join(sizes.alias("z"), F.col("j.conv_id").eqNullSafe(F.col("z.conv_id"))).select("j.*", "z.sizes", "z.pieces")
    sized = saved(sized, "plans")
    plans = sized.mapInArrow(_dealt(_arrow(_PLAN)), _PLAN)
    same = F.col("c.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("c.place") == F.col("p.place"))
    texts = cut.select("conv_id", "place", "roles", "texts").alias("c").join(plans.alias("p"), same)
    texts = texts.select("c.*", "p.letters", "p.codes", "p.state", "p.report")
    ddl = f"conv_id bigint, piece int, report {_REPORT}, repaired {_ROWS}"
    pieces = texts.mapInArrow(_applied(_arrow(ddl)), ddl).alias("t")
    counts = sized.select("conv_id", F.col("pieces").cast("int").alias("pieces")).alias("n")
    pieces = pieces.join(counts, F.col("t.conv_id").eqNullSafe(F.col("n.conv_id"))).select("t.conv_id", "t.piece", "n.pieces", "t.report", "t.repaired")
    return whole.unionByName(pieces)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    return rows.withColumn("fault", fault).filter("fault <> 0").select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", "".join(ENDINGS), "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _hashed(schema: pa.Schema):
    """SHA-256 of conversations in several pieces, which come in order.

    A hash of one text cannot be split; the text streams through.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hashed, report, lines = object(), None, None, 0

        def closed() -> Iterator[pa.RecordBatch]:
            if hashed is not None:
                yield from pa.Table.from_pylist([{"conv_id": current, "report": report, "repaired_sha256": hashed.hexdigest()}], schema=schema).to_batches()

        for batch in batches:
            for conv, piece, told, text, n in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if conv != current or piece == 0:
                    yield from closed()
                    current, hashed, report, lines = conv, hashlib.sha256(), told, 0
                if n:
                    hashed.update(("\n" if lines else "").encode() + text.encode("utf-8"))
                    lines += n
        yield from closed()

    return run


def digests(pieces: DataFrame) -> DataFrame:
    """``conv_id``, report and SHA-256 of the lines ``role:text`` of ``repair``."""
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    one = pieces.filter("pieces = 1").select("conv_id", "report", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    many = pieces.filter("pieces > 1").select("conv_id", "piece", "report", lines.alias("text"), F.size("repaired").alias("n"))
    ddl = f"conv_id bigint, report {_REPORT}, repaired_sha256 string"
    many = many.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_hashed(_arrow(ddl)), ddl)
    return one.unionByName(many).select("conv_id", "report.*", "repaired_sha256")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``, repaired after damage.

    A conversation that lost all its rows has zeros, no letters, and the hash
    of an empty text.  Other inputs as in ``repair``.
    """
    found = digests(repair(damaged(conversations))).alias("r")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("i")
    rows = every.join(found, F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    numbers = [F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(
        "i.conv_id", *numbers, F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("r.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
