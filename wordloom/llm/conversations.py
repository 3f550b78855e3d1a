"""Repair of conversations: the cheapest edits that make roles go system, user, assistant, user, assistant, ...

The rows of a conversation and four states of the grammar make a graph; forward and backward minimum costs tell which
of its arcs are on some cheapest way (tight arcs), and of these a set of states walks along, at each step by the least
letter that any of them offers. Conversations of up to LONG rows are repaired in one piece. Longer ones are cut into
blocks: each block's costs between states are a small matrix, matrices give the costs at the blocks' borders, and every
block finds its letters by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wordloom.llm.common import cut, ensure_checkpoint_dir
from wordloom.llm.simhash import whole_groups

#: Rows of a conversation that one task repairs in one piece.
LONG = 50_000
#: Long conversations up to so many are told apart by a broadcast list.
MOST_SENT = 10_000
#: States: nothing yet; after a system row; after a user row; after an assistant row. The first and the last may end.
STATES, ENDS = range(4), (0, 3)
#: Next state by state and role initial; the places of s, u, a are 0, 1, 2, of any other 3.
FOLLOWS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
NAMES = {1: "user", 2: "assistant"}
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
FAR = 1 << 60
#: A row's symbol: the place of its role's initial, plus 4 if it is truncated; or GONE if it has to be deleted.
TRUNCATED, GONE = 4, 8


@cache
def arcs(symbol: int) -> tuple[tuple[int, str, int, int], ...]:
    """(state before, letter, state after, cost) of what may be done with a row."""
    found = [(q, DELETE, q, COSTS[DELETE]) for q in STATES]
    if symbol != GONE:
        more, own = divmod(symbol, TRUNCATED)
        for (q, initial), r in FOLLOWS.items():
            if initial == own:
                found.append((q, KEEP, r, COSTS[KEEP] + more))
            if initial in NAMES:
                found.append((q, REROLE, r, COSTS[REROLE] + more))
    return tuple(found)


#: Rows put in between, whatever follows.
INSERTS = tuple((q, INSERT, r, COSTS[INSERT]) for (q, initial), r in FOLLOWS.items() if initial in NAMES)


def forward_inserts(cost: list[int]) -> list[int]:
    out = list(cost)
    for _ in range(2):  # two of them lead from a state to any other that can be reached
        for q, _, r, c in INSERTS:
            out[r] = min(out[r], out[q] + c)
    return out


def backward_inserts(cost: list[int]) -> list[int]:
    out = list(cost)
    for _ in range(2):
        for q, _, r, c in INSERTS:
            out[q] = min(out[q], out[r] + c)
    return out


def forward(symbols: bytes, cost: list[int]) -> list[list[int]]:
    """Least costs from the beginning to each state, before each row (rows put in before it included) and after the last."""
    out = []
    for s in symbols:
        cost = forward_inserts(cost)
        out.append(cost)
        after = [FAR] * 4
        for q, _, r, c in arcs(s):
            after[r] = min(after[r], cost[q] + c)
        cost = after
    return [*out, cost]


def backward(symbols: bytes, cost: list[int]) -> list[list[int]]:
    """Least costs from each state to the end, before each row and after the last; `cost` holds those after the last."""
    out = [cost]
    for s in reversed(symbols):
        before = [FAR] * 4
        for q, _, r, c in arcs(s):
            before[q] = min(before[q], cost[r] + c)
        cost = backward_inserts(before)
        out.append(cost)
    return out[::-1]


#: Costs after the last row: what is put in at the end.
AT_END = backward_inserts([0 if q in ENDS else FAR for q in STATES])


def walk(symbols: bytes, ahead: list[list[int]], behind: list[list[int]], total: int, states: frozenset[int], last: bool) -> tuple[str, frozenset[int]]:
    """(least letters, states reached) along tight arcs from some states before the first row; in the last block up to the end of the conversation."""
    out, i = [], 0
    while True:
        offers: dict[str, tuple[int, set[int]]] = {}

        def offer(letter: str, q: int, r: int, c: int, at: int, step: int) -> None:
            if q in states and ahead[at][q] + c + behind[at + step][r] == total:
                offers.setdefault(letter, (step, set()))[1].add(r)

        if i < len(symbols) or last:
            for q, letter, r, c in INSERTS:
                offer(letter, q, r, c, i, 0)
        if i < len(symbols):
            for q, letter, r, c in arcs(symbols[i]):
                offer(letter, q, r, c, i, 1)
        if not offers:
            return "".join(out), states
        letter = min(offers)
        step, found = offers[letter]
        states, i = frozenset(found), i + step
        out.append(letter)


def repaired(symbols: bytes) -> tuple[int, str]:
    """(cost, letters) of a whole conversation."""
    behind = backward(symbols, AT_END)
    ahead = forward(symbols, [0, FAR, FAR, FAR])
    ahead[-1] = forward_inserts(ahead[-1])
    total = behind[0][0]
    return total, walk(symbols, ahead, behind, total, frozenset([0]), True)[0]


class Texts:
    """The hash of the repaired rows, made row by row."""

    def __init__(self):
        self.hash, self.some, self.state = hashlib.sha256(), False, 0

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.some}{role}:{text}".encode())
        self.some = True

    def apply(self, letters: str, roles: list[str], texts: list[str]) -> None:
        """Letters with the rows that they belong to, in order. The grammar leaves one role to put in or to give."""
        rows = iter(zip(roles, texts, strict=True))
        for letter in letters:
            role, text = ("", "") if letter == INSERT else next(rows)
            if letter == DELETE:
                continue
            if letter == KEEP:
                self.state = FOLLOWS[self.state, "sua".index(role[0])]
            else:
                self.state = 3 if self.state == 2 else 2
                role = NAMES[self.state - 1]
            self.add(role, text)


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(_conv, _c, _turn, _role, _text, _drop) after the damage that the checksum of conversation and turn decides; dropped rows stay, marked."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one(conv), F.lit(":"), one(turn)).cast("binary")) % 20
    base = rows.select(
        F.col(conv).alias("_conv"), F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("_c"), F.col(turn).cast("long").alias("_turn"), kind.alias("_kind"),
        one(role).alias("_role"), one(text).alias("_text"))
    return (base.withColumn("_role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")))
            .withColumn("_text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")))
            .withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .withColumn("_drop", F.col("_kind") == 0).drop("_kind"))


def with_symbols(rows: DataFrame) -> DataFrame:
    """Adds _blank and _symbol, as if no row were a duplicate."""
    initial = F.substring("_role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    last = F.substring(F.rtrim(F.col("_text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    return rows.withColumns({"_blank": ~F.col("_text").rlike(r"[^\x20\x09-\x0D]"), "_symbol": place + F.when(last.isin(".", "!", "?"), 0).otherwise(TRUNCATED)})


LEGAL = {(0, 1), (1, 2), (2, 1)}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = [pa.field(c, pa.int64()) for c in COUNTS] + [pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
RESULT_TYPES = ", ".join([*[f"{c} long" for c in COUNTS], "audit string", "repaired_sha256 string"])


def whole_conversation(turns: list, roles: list[str], texts: list[str], blank: list[bool], symbols: list[int]) -> list:
    """The values of RESULT for the rows of one conversation in order."""
    seen: set[tuple[str, str]] = set()
    n = {"blank": 0, "duplicate": 0, "truncated": 0}
    out = bytearray()
    for role, text, empty, s in zip(roles, texts, blank, symbols, strict=True):
        again = (role, text) in seen
        seen.add((role, text))
        fault = "blank" if empty else "duplicate" if again else "truncated" if s >= TRUNCATED else None
        if fault:
            n[fault] += 1
        out.append(GONE if empty or again else s)
    known = [t for t in turns if t is not None]
    places = [s % TRUNCATED for s in symbols]
    cost, audit = repaired(bytes(out))
    done = Texts()
    done.apply(audit, roles, texts)
    return [known[-1] - known[0] + 1 - len(set(known)) if known else 0, *n.values(), sum(p not in LEGAL for p in zip(places, places[1:], strict=False)), cost, audit, done.hash.hexdigest()]


def in_one_piece(rows: DataFrame) -> DataFrame:
    """(_c, _conv, RESULT) of conversations of up to LONG rows: dealt by conversation, sorted, repaired one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 1):
            columns = [table.column(k).to_pylist() for k in range(2, 8)]
            found = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                drop, *own = [c[s:e] for c in columns]
                found.append(whole_conversation(*[[x for x, d in zip(c, drop, strict=True) if not d] for c in own]))
            values = [pa.array([f[k] for f in found], RESULT[k].type) for k in range(len(RESULT))]
            ids = table.column(1).combine_chunks().take(pa.array(bounds[:-1]))
            yield pa.RecordBatch.from_arrays([ids, *values], ["_conv", *[f.name for f in RESULT]])

    schema = StructType([StructField("_conv", rows.schema["_conv"].dataType), *rows.sparkSession.createDataFrame([], RESULT_TYPES).schema.fields])
    order = ["_c", F.asc_nulls_first("_turn"), "_role", "_text", "_copy"]
    ready = with_symbols(rows).repartition("_c").sortWithinPartitions(*order)
    return ready.select("_c", "_conv", "_drop", "_turn", "_role", "_text", "_blank", "_symbol").mapInArrow(run, schema)


def by_columns(table: pa.Table) -> dict[str, list]:
    return {c: table.column(c).to_pylist() for c in table.column_names}


def block_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: symbols, counts, first and last turn and place, and the least costs between states."""
    for table, bounds in whole_groups(batches, 2):
        rows = by_columns(table)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = {c: v[s:e] for c, v in rows.items()}
            gone = [b or d for b, d in zip(own["_blank"], own["_again"], strict=True)]
            symbols = bytes(GONE if g else x for g, x in zip(gone, own["_symbol"], strict=True))
            places = [x % TRUNCATED for x in own["_symbol"]]
            known = [t for t in own["_turn"] if t is not None]
            yield pa.RecordBatch.from_pylist([{
                "_c": own["_c"][0], "_block": own["_block"][0], "symbols": symbols, "costs": [c for q in STATES for c in forward(symbols, [0 if r == q else FAR for r in STATES])[-1]],
                "blank": sum(own["_blank"]), "duplicate": sum(d and not b for b, d in zip(own["_blank"], own["_again"], strict=True)),
                "truncated": sum(x >= TRUNCATED and not g for x, g in zip(own["_symbol"], gone, strict=True)), "illegal": sum(p not in LEGAL for p in zip(places, places[1:], strict=False)),
                "places": [places[0], places[-1]], "turns": [known[0], known[-1]] if known else [], "n_turns": len(set(known))}], schema=SUMMARY)


SUMMARY = pa.schema([("_c", pa.string()), ("_block", pa.int64()), ("symbols", pa.binary()), ("costs", pa.list_(pa.int64())), *[(c, pa.int64()) for c in COUNTS[1:5]],
                     ("places", pa.list_(pa.int32())), ("turns", pa.list_(pa.int64())), ("n_turns", pa.int64())])
SUMMARY_TYPES = "_c string, _block long, symbols binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, places array<int>, turns array<long>, n_turns long"


def borders(table: pa.Table) -> pa.Table:
    """Of the blocks of one conversation: the costs from the beginning to each block and from its end on, and the conversation's counts. Blocks are as many as range partitions at most."""
    blocks = sorted(table.to_pylist(), key=lambda b: b["_block"])
    ahead = [[0, FAR, FAR, FAR]]
    for b in blocks:
        ahead.append([min(min(FAR, ahead[-1][q] + b["costs"][4 * q + r]) for q in STATES) for r in STATES])
    behind = [AT_END]
    for b in reversed(blocks):
        behind.insert(0, [min(min(FAR, b["costs"][4 * q + r] + behind[0][r]) for r in STATES) for q in STATES])
    known = [b for b in blocks if b["turns"]]
    joined = sum(a["turns"][1] == b["turns"][0] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1]["turns"][1] - known[0]["turns"][0] + 1 - sum(b["n_turns"] for b in known) + joined if known else 0
    illegal = sum(b["illegal"] for b in blocks) + sum((a["places"][1], b["places"][0]) not in LEGAL for a, b in zip(blocks, blocks[1:], strict=False))
    totals = [gaps, *[sum(b[c] for b in blocks) for c in COUNTS[1:4]], illegal, behind[0][0]]
    return pa.Table.from_pylist([{"_c": b["_c"], "_block": b["_block"], "ahead": ahead[k], "behind": behind[k + 1], "last": k == len(blocks) - 1, "totals": totals}
                                 for k, b in enumerate(blocks)], schema=BORDER)


BORDER = pa.schema([("_c", pa.string()), ("_block", pa.int64()), ("ahead", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64())), ("last", pa.bool_()), ("totals", pa.list_(pa.int64()))])
BORDER_TYPES = "_c string, _block long, ahead array<long>, behind array<long>, last boolean, totals array<long>"


def block_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and each state in which a cheapest way may enter it, the letters and the state in which it is left."""
    for b in batches:
        for row in b.to_pylist():
            ahead, behind = forward(row["symbols"], row["ahead"]), backward(row["symbols"], row["behind"])
            total = row["totals"][-1]
            if row["last"]:
                ahead[-1] = forward_inserts(ahead[-1])
            found = []
            for q in STATES:
                # A state that was entered by a row; those put in before the first row belong to this block.
                if row["ahead"][q] + behind[0][q] == total:
                    letters, reached = walk(row["symbols"], ahead, behind, total, frozenset([q]), row["last"])
                    found.append({"from": q, "letters": letters, "to": min(reached)})
            yield pa.RecordBatch.from_pylist([{"_c": row["_c"], "_block": row["_block"], "totals": row["totals"], "ways": found}], schema=WAYS)


WAY = pa.struct([("from", pa.int32()), ("letters", pa.string()), ("to", pa.int32())])
WAYS = pa.schema([("_c", pa.string()), ("_block", pa.int64()), ("totals", pa.list_(pa.int64())), ("ways", pa.list_(WAY))])
WAYS_TYPES = "_c string, _block long, totals array<long>, ways array<struct<from:int,letters:string,to:int>>"


def entered(table: pa.Table) -> pa.Table:
    """The state in which each block of one conversation is entered."""
    state, out = 0, []
    for b in sorted(table.to_pylist(), key=lambda b: b["_block"]):
        out.append({"_c": b["_c"], "_block": b["_block"], "state": state})
        state = next(w["to"] for w in b["ends"] if w["from"] == state)
    return pa.Table.from_pylist(out, schema=pa.schema([("_c", pa.string()), ("_block", pa.int64()), ("state", pa.int32())]))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_c, audit, repaired_sha256): blocks' letters and rows one after the other; only a block's letters are held, besides the audit itself."""
    last, done, audit, letters, at = None, Texts(), [], "", 0

    def finish() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last]), pa.array(["".join(audit)]), pa.array([done.hash.hexdigest()])], ["_c", "audit", "repaired_sha256"])

    for b in batches:
        for c, given, role, text in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if given is not None or c != last:
                if at < len(letters):
                    done.apply(letters[at:], [], [])  # rows put in at the end
                if c != last:
                    if last is not None:
                        yield finish()
                    last, done, audit = c, Texts(), []
                letters, at = given, 0
                audit.append(given)
                continue
            end = at
            while letters[end] == INSERT:
                end += 1
            done.apply(letters[at:end + 1], [role], [text])
            at = end + 1
    if last is not None:
        if at < len(letters):
            done.apply(letters[at:], [], [])
        yield finish()


def in_blocks(rows: DataFrame) -> DataFrame:
    """(_c, RESULT) of long conversations. Rows are cut into blocks by ranges of their order; the text hash, one after the other by nature, streams over sorted rows and holds none."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_c", F.asc_nulls_first("_turn"), "_role", "_begin", "_text_hash", "_row"]
    keyed = with_symbols(rows.where("not _drop")).withColumns({"_begin": F.substring("_text", 1, 64), "_text_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    ordered = cut(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    digest = F.md5(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text")))
    narrow = ordered.select("_c", F.shiftright("_at", 33).alias("_block"), "_at", "_turn", "_blank", "_symbol", digest.alias("_digest"))
    first = narrow.groupBy("_c", "_digest").agg(F.min("_at").alias("_first"))
    told = narrow.join(first, ["_c", "_digest"]).withColumn("_again", F.col("_at") > F.col("_first"))
    columns = ["_c", "_block", "_turn", "_blank", "_again", "_symbol"]
    blocks = cut(told.repartition("_c", "_block").sortWithinPartitions("_c", "_block", "_at").select(*columns).mapInArrow(block_summaries, SUMMARY_TYPES))
    edges = blocks.drop("symbols").groupBy("_c").applyInArrow(borders, BORDER_TYPES)
    ways = cut(blocks.select("_c", "_block", "symbols").join(edges, ["_c", "_block"]).mapInArrow(block_letters, WAYS_TYPES))
    ends = ways.select("_c", "_block", F.transform("ways", lambda w: F.struct(w["from"].alias("from"), w["to"].alias("to"))).alias("ends"))
    states = ends.groupBy("_c").applyInArrow(entered, "_c string, _block long, state int")
    taken = ways.join(states, ["_c", "_block"]).select("_c", "_block", F.filter("ways", lambda w: w["from"] == F.col("state"))[0]["letters"].alias("_letters"))
    stream = (taken.select("_c", "_block", F.lit(-1).cast("long").alias("_at"), "_letters", F.lit(None).cast("string").alias("_role"), F.lit(None).cast("string").alias("_text"))
              .unionByName(ordered.select("_c", F.shiftright("_at", 33).alias("_block"), "_at", F.lit(None).cast("string").alias("_letters"), "_role", "_text")))
    texts = (stream.repartition("_c").sortWithinPartitions("_c", "_block", "_at").select("_c", "_letters", "_role", "_text")
             .mapInArrow(hashed, "_c string, audit string, repaired_sha256 string"))
    totals = ways.groupBy("_c").agg(F.first("totals").alias("_t"))
    return texts.join(totals, "_c").select("_c", *[F.col("_t")[k].alias(c) for k, c in enumerate(COUNTS)], "audit", "repaired_sha256")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row for each different conversation id: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after the fixed damage.

    Rows of a conversation go by turn, null turns first; those of one turn by role, then by text (in conversations of more
    than `long` rows by the text's first 64 characters, then by a hash of it). Null roles and texts are one space, a null
    conversation id is a conversation of its own. Rows that repeat another one are duplicates of it. A conversation that
    the damage leaves without rows has zeros, no edits and the hash of nothing. Texts of any length are read whole. Columns
    other than the four named are not read. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    hurt = damaged(rows, conv_col, turn_col, role_col, text_col)
    many = cut(hurt.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"), F.first("_conv").alias("_conv")).where(F.col("_n") > long).select("_c", "_conv"))
    n = many.count()
    names = [F.col("_conv").alias(conv_col), *COUNTS, "audit", "repaired_sha256"]
    if not n:
        return in_one_piece(hurt).select(*names)
    listed = F.broadcast(many) if n <= MOST_SENT else many
    short = in_one_piece(hurt.join(listed.select("_c"), "_c", "left_anti")).select(*names)
    found = in_blocks(hurt.join(listed.select("_c"), "_c", "left_semi"))
    nothing = {c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    return short.unionByName(many.join(found, "_c", "left").withColumns(nothing).select(*names))
