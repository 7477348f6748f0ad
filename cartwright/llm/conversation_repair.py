"""Repair of the structure of conversations.

A conversation should read as an optional system turn and then turns of user and assistant by turns.
The cheapest edits that make it so come from a Viterbi pass over its rows, sorted by Spark and read as
a stream. Survivors are the cheapest ways to each state of the wanted pattern; their edits form a tree
of back pointers whose nodes count their references. A survivor that can't win any more goes, and
with it every node only it refers to; as soon as all survivors share their first edits, those are
emitted and forgotten. What is held is what is still open. Ways of equal cost are told apart by the
whole of what is open: the first letters in which two survivors differ are carried along.
"""

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What splits words; a text of nothing else is blank.
BLANK = r"\x20\x09-\x0D"

# Costs of the edits, by the letter each leaves in the audit; CUT is added where a text without an end stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The pattern (s?(ua)+)?: where a role's initial leads from each state.
LEADS = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
ENDS = (START, ASSISTANT)
#: The only role that a changed or new row may have in each state.
NEEDED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}

SUMMARY = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults: a row is dropped, emptied, robbed of its ends of sentences, repeated
    or given to the user, as crc32 of ``conv_id:turn`` modulo 20 is 0 to 4. Nulls become one space."""
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(F.concat_ws(":", conv_id, turn).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return marked.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, blank, cut, again): a conversation's rows one after the other.

    ``again``: role and text stand in an earlier turn. Rows equal in all are neighbours and are left
    to the reader. The first turn of each role and text comes from counts by digest, summed
    before they are shuffled, and only of texts that occur twice, so that neither many copies nor a
    very long conversation is a hot group here.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = plain.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    firsts = (
        plain.groupBy(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("digest").alias("same"))
        .agg(F.count("*").alias("times"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unset"))
        .where("times > 1")
    )
    met = plain.join(
        firsts,
        F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("digest") == F.col("same")),
        "left",
    )
    later: Column = F.col("turn").isNotNull() & (F.col("unset") | (F.col("turn") > F.col("first")))
    flagged = met.select(
        "conv_id", "turn", "role", "text",
        (~F.col("text").rlike(f"[^{BLANK}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{BLANK}]*\z")).alias("cut"),
        F.coalesce(later, F.lit(False)).alias("again"),
    )
    return flagged.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text"
    )


def _moves(state: int, initial: str, bound: bool, cut: bool) -> list[tuple[str, int, int]]:
    """(letter, state, cost) of what may be done with a row; ``bound``: it has to go."""
    out = [("D", state, DELETE)]
    if not bound:
        more = CUT if cut else 0
        if (state, initial) in LEADS:
            out.append(("K", LEADS[state, initial], KEEP + more))
        out.append(("R", LEADS[state, NEEDED[state][0]], REROLE + more))
    return out


def _inserted(state: int) -> int:
    return LEADS[state, NEEDED[state][0]]


def _lags() -> dict[tuple[int, int], int]:
    """(p, q): how much more than from p the cheapest edits from q cost at most, whatever rows follow.

    The least values that hold for the end and, whatever is done from p with one row of any kind, for
    the best answer from q.
    """
    kinds = [(i, b, c) for i in ("s", "u", "a", "") for b in (False, True) for c in (False, True)]

    def steps(state: int, kind: tuple[str, bool, bool]) -> list[tuple[int, int]]:
        out, made = [], 0
        for _ in range(3):
            out += [(to, cost + made) for _, to, cost in _moves(state, *kind)]
            state, made = _inserted(state), made + INSERT
        return out

    def end(state: int) -> int:
        return 0 if state in ENDS else INSERT + end(_inserted(state))

    lags = {(p, q): 0 for p in STATES for q in STATES}
    while True:
        new = {
            (p, q): max(
                [0, end(q) - end(p)]
                + [
                    min(cost_q - cost_p + lags[to_p, to_q] for to_q, cost_q in steps(q, kind))
                    for kind in kinds
                    for to_p, cost_p in steps(p, kind)
                ]
            )
            for p, q in lags
        }
        if new == lags:
            return lags
        lags = new


LAGS = _lags()

#: Survivors: for each the state and the cost above the least; for each pair the first letters that differ.
Survivors = tuple[tuple[tuple[int, int], ...], tuple[tuple[str, str], ...]]


def _apart(a: str, b: str) -> tuple[str, str]:
    """Two strings from the first letter on in which they differ; cut there if both go on."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), None)
    if at is not None:
        return a[at], b[at]
    common = min(len(a), len(b))
    return a[common:], b[common:]


def _followed(survivors: Survivors, ways: list[tuple[int, int, str, int]]) -> tuple[Survivors, tuple, int]:
    """The best of the ways (cost, place of the survivor it goes on from, letters, state) to each state.

    Gives the new survivors, (place, letters) of each, and the least cost. Of ways of equal cost the
    one of the least letters stays, those before the new ones included. Survivors that can't
    be among the cheapest whatever follows are left out.
    """
    pairs = {}
    for (p, q), (a, b) in zip(((p, q) for p in range(len(survivors[0])) for q in range(p)), survivors[1]):
        pairs[p, q], pairs[q, p] = (a, b), (b, a)

    def difference(x, y):
        a, b = pairs[x[1], y[1]] if x[1] != y[1] else ("", "")
        return _apart(a + x[2], b + y[2])

    best: dict[int, tuple[int, int, str, int]] = {}

    def offer(way) -> bool:
        old = best.get(way[3])
        if old is not None:
            if old[0] < way[0]:
                return False
            if old[0] == way[0]:
                new_letters, old_letters = difference(way, old)
                if new_letters >= old_letters:
                    return False
        best[way[3]] = way
        return True

    for way in ways:
        offer(way)
    changed = True
    while changed:  # rows may be put in after each row
        changed = False
        for cost, place, letters, state in list(best.values()):
            changed |= offer((cost + INSERT, place, letters + "I", _inserted(state)))
    least = min(way[0] for way in best.values())
    stay = sorted(
        (w for s, w in best.items() if all(w[0] <= o[0] + LAGS[s, t] for t, o in best.items())), key=lambda w: w[3]
    )
    apart = tuple(difference(stay[p], stay[q]) for p in range(len(stay)) for q in range(p))
    return (tuple((w[3], w[0] - least) for w in stay), apart), tuple((w[1], w[2]) for w in stay), least


@functools.lru_cache(maxsize=None)  # relative costs are bounded by LAGS, so the cases are few
def _begun() -> tuple[Survivors, tuple, int]:
    return _followed((((START, 0),), ()), [(0, 0, "", START)])


@functools.lru_cache(maxsize=1 << 16)
def _stepped(survivors: Survivors, initial: str, bound: bool, cut: bool) -> tuple[Survivors, tuple, int]:
    ways = [
        (cost + more, place, letter, to)
        for place, (state, cost) in enumerate(survivors[0])
        for letter, to, more in _moves(state, initial, bound, cut)
    ]
    return _followed(survivors, ways)


class _Node:
    """An edit that is still open: what it gives, the edit before it, and who refers to it."""

    __slots__ = ("before", "after", "held", "letter", "role", "text")

    def __init__(self, before, letter, role, text):
        self.before, self.letter, self.role, self.text = before, letter, role, text
        self.after: set[_Node] = set()
        self.held = False  # by a survivor
        if before is not None:
            before.after.add(self)


class Repair:
    """One conversation's rows, one after the other; ``decided`` has the edits settled by then."""

    def __init__(self):
        self.root = _Node(None, "", "", "")
        self.decided: list[tuple[str, str, str]] = []
        self.cost, self.tips = 0, []
        self.survivors = (((START, 0),), ())
        self._move([self.root], _begun(), "", "")

    def _move(self, tips: list[_Node], step: tuple[Survivors, tuple, int], role: str, text: str) -> None:
        old = self.survivors
        self.survivors, origins, least = step
        self.cost += least
        made: dict[tuple[int, str], _Node] = {}
        new = []
        for place, letters in origins:
            node, state = tips[place], old[0][place][0]
            for n in range(1, len(letters) + 1):
                key = place, letters[:n]
                letter = letters[n - 1]
                if letter == "I":
                    given = NEEDED[state], ""
                elif letter == "R":
                    given = NEEDED[state], text
                else:
                    given = role, text
                if letter != "D":
                    state = LEADS[state, given[0][0]]
                if key not in made:
                    made[key] = _Node(node, letter, *(given if letter != "D" else ("", "")))
                node = made[key]
            new.append(node)
        for tip in tips:
            tip.held = False
        for tip in new:
            tip.held = True
        for tip in {*tips, *made.values()}:  # what nobody refers to goes, and what only it referred to
            while tip is not self.root and not tip.held and not tip.after and tip.before is not None:
                before, tip.before = tip.before, None
                before.after.discard(tip)
                tip = before
        self.tips = new
        while not self.root.held and len(self.root.after) == 1:
            self.root = self.root.after.pop()
            self.root.before = None
            self.decided.append((self.root.letter, self.root.role, self.root.text))
            self.root.role = self.root.text = ""

    def row(self, role: str, text: str, bound: bool, cut: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        self._move(self.tips, _stepped(self.survivors, initial, bound, cut), role, text)

    def open_edits(self) -> int:
        """The longest way that is still open."""
        longest = 0
        for tip in self.tips:
            n, node = 0, tip
            while node is not self.root:
                n, node = n + 1, node.before
            longest = max(longest, n)
        return longest

    def end(self) -> None:
        """Settles all edits: of the ways that end in the pattern the cheapest, the least of these."""
        ending = [(cost, place, "", state) for place, (state, cost) in enumerate(self.survivors[0])]
        best = _followed(self.survivors, ending)
        ends = [i for i, (state, _) in enumerate(best[0][0]) if state in ENDS]

        def less(i: int, j: int) -> bool:
            (_, cost_i), (_, cost_j) = best[0][0][i], best[0][0][j]
            if cost_i != cost_j:
                return cost_i < cost_j
            p, q = max(i, j), min(i, j)
            a, b = best[0][1][p * (p - 1) // 2 + q]
            return (a < b) if i == p else (b < a)

        chosen = ends[0]
        for other in ends[1:]:
            if less(other, chosen):
                chosen = other
        self._move(self.tips, best, "", "")
        self.cost += self.survivors[0][chosen][1]
        path, node = [], self.tips[chosen]
        while node is not self.root:
            path.append((node.letter, node.role, node.text))
            node = node.before
        self.decided += reversed(path)


class _Conversation:
    """Figures of a conversation along its rows."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.last = None
        self.turns = self.lines = 0
        self.audit, self.digest = [], hashlib.sha256()

    def row(self, turn, role: str, text: str, blank: bool, cut: bool, again: bool) -> None:
        same = self.last == (turn, role, text)
        if turn is not None and (self.most is None or turn > self.most):
            self.turns += 1
            self.most = turn
            self.least = turn if self.least is None else self.least
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = turn, role, text
        duplicate = not blank and (again or same)
        cut = cut and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut
        self.repair.row(role, text, blank or duplicate, cut)

    def taken(self) -> list[tuple[str, str, str]]:
        """The edits settled since last asked; the audit and the digest go on by them."""
        edits, self.repair.decided = self.repair.decided, []
        for letter, role, text in edits:
            self.audit.append(letter)
            if letter != "D":
                self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                self.lines += 1
        if len(self.audit) > 4096:
            self.audit = ["".join(self.audit)]
        return edits

    def summary(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.repair.cost,
            "".join(self.audit), self.digest.hexdigest(),
        )


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[_Conversation, bool]]:
    """Each conversation after a part of its rows, and once more at its end (True)."""
    current = None
    for batch in batches:
        columns = [batch[c].tolist() for c in ("conv_id", "turn", "role", "text", "blank", "cut", "again")]
        nulls = batch["conv_id"].isna().tolist(), batch["turn"].isna().tolist()
        for at, (conv, turn, role, text, blank, cut, again) in enumerate(zip(*columns)):
            conv = None if nulls[0][at] else conv
            if current is None or current.conv_id != conv:
                if current is not None:
                    current.repair.end()
                    yield current, True
                current = _Conversation(conv)
            current.row(None if nulls[1][at] else int(turn), role, text, blank, cut, again)
            if len(current.repair.decided) >= 256:
                yield current, False
    if current is not None:
        current.repair.end()
        yield current, True


def _key_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _with_text_keys(rows: DataFrame) -> DataFrame:
    """Keys as text, which a null doesn't turn into a floating number."""
    return in_order(rows).withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")})


def summaries(rows: DataFrame) -> DataFrame:
    """A row a conversation: its faults, the cost and letters of its cheapest edits, the repaired digest.

    ``rows`` have conv_id, turn, role and text, in any order; other columns are not read. Rows are
    taken by turn, nulls first, then by role and text. A null role or text counts as one space, a null
    conv_id as one conversation. A row whose role begins with none of s, u and a can't be kept. Texts of
    any length pass; an empty table gives no rows. A conversation is read as a stream by one task, as
    its digest needs; the sort before it is Spark's and spills, and only open edits are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", *[c.split()[0] for c in SUMMARY.split(", ")]]
        out = []
        for conversation, over in _stream(batches):
            conversation.taken()
            if over:
                out.append(conversation.summary())
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    found = _with_text_keys(rows).mapInPandas(run, f"conv_id string, {SUMMARY}")
    return found.withColumn("conv_id", F.col("conv_id").cast(_key_type(rows)))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations, and by which edit
    (K kept, R given another role, I put in) each stands there. See ``summaries`` for what is read how."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, names = [], ["conv_id", "place", "edit", "role", "text"]
        for conversation, _ in _stream(batches):
            place = conversation.lines
            for letter, role, text in conversation.taken():
                if letter != "D":
                    out.append((conversation.conv_id, place, letter, role, text))
                    place += 1
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    found = _with_text_keys(rows).mapInPandas(run, "conv_id string, place long, edit string, role string, text string")
    return found.withColumn("conv_id", F.col("conv_id").cast(_key_type(rows)))


def every_summary(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``summaries`` of all conversations of ``ids``; those without rows have zeros and empty edits."""
    found = summaries(rows).withColumnRenamed("conv_id", "found_id")
    whole = ids.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    return whole.select(
        "conv_id", *[F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("bigint"))).alias(c) for c in names]
    )
