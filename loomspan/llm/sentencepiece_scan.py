"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is a lattice: nodes are pieces at places, and a node may follow another that ends where it
begins. Weights add along a path and the best path wins (the max-plus semiring). For a unigram model a
node weighs the score of its piece and any two may follow each other. For a BPE model all nodes weigh
nothing, and a pair weighs nothing if merging the two pieces' characters from scratch yields just
these two, else minus infinity: one path of finite weight is left, which is what the merges produce.

Giant documents are cut every ``PART`` characters, wherever that falls. The states at a cut are the
nodes that cover the character before it, known from the few characters around the cut alone, so each
chunk is a row of its own that yields its transfer matrix: the best weight from each state at its left
cut to each at its right cut. Matrices combine associatively: a document's are combined pairwise up a
tree, and back down the tree each chunk learns the state at either of its cuts, between which it is
then traced on its own, wherever its row is. (A Spark string holds 2 GB, so a document has no more than
32,768 of these small matrices.)

No piece holds two characters side by side that no piece has side by side, word starts above all. Such
places have a single state, so a chunk's matrix is the product of a column (up to the first such
place), numbers (the words between) and a row (from the last one on); the words, chunks of one entry
each, are shared between all texts of a batch. Chunks without any such place, and words of more than
``CHUNK`` characters, which are cut the same way, have full matrices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 48  # characters of a word between cuts
PART = 1 << 16  # characters of a document in a row
SLICE = 1 << 21  # characters encoded at once
PAIRS, WORDS = 150_000, 150_000  # judged pairs and encoded words that a worker remembers
MARK = "▁"
MINUS = -np.inf
State = tuple[int, str]  # where a node starts, and the node; no node where there is a single state


class Pieces:
    """A model's pieces and the lattice over them."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without normalisation, with escaped blanks, are supported")
        self.prefix = spec.add_dummy_prefix
        self.bpe = proto.trainer_spec.model_type == 2
        self.text = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        normal = [i for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        self.ids = {proto.pieces[i].piece: i for i in normal}
        self.number = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        self.score = {i: proto.pieces[i].score for i in normal}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.lowest = min(self.score.values()) - 10.0
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("only models whose pieces have word starts in front are supported")
        self.unit = units(self.ids)
        self.near = {x + y for p in self.ids for x, y in zip(p, p[1:], strict=False)}
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.steps: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.ending: dict[str, tuple[str, ...]] = {}
        self.longest = max(map(len, self.ids))
        fixed = {2: " \u2047 ", 3: ""}
        self.written = [bytes([int(t[3:5], 16)]) if k == 6 else fixed.get(k, t).encode() for t, k in zip(self.text, self.kind, strict=True)]
        self.follows: dict[str, dict[str, bool]] = {}
        self.judged = 0
        self.last: dict[str, tuple[str, str, float] | None] = {}
        self.words = Words(self.word)
        self.before: tuple[str, list[str | None], list[float], list[str]] = ("", [""], [0.0], [""])  # the text and row scanned last
        self.rows = self.matrices = 0  # of transfer matrices made so far

    def merged(self, text: str) -> list[str]:
        """The merges applied to a short text: highest score first, leftmost among equals."""
        part = list(text)
        while len(part) > 1:
            best, at = MINUS, -1
            for i in range(len(part) - 1):
                got = self.ids.get(part[i] + part[i + 1])
                if got is not None and self.score[got] > best:
                    best, at = self.score[got], i
            if at < 0:
                break
            part[at : at + 2] = [part[at] + part[at + 1]]
        return part

    def nodes_at(self, text: str, p: int) -> list[str]:
        """The pieces that may start at p; a character that is no piece is a node of its own."""
        return [text[p], *(node for n in range(p + 2, min(len(text), p + self.longest) + 1) if (node := text[p:n]) in self.ids)]

    def weight(self, node: str) -> float:
        return 0.0 if self.bpe else self.score.get(self.ids.get(node, -1), self.lowest)

    def may_follow(self, left: str, right: str) -> bool:
        """Whether two neighbouring nodes stand together: for merges, if they alone come out as these two."""
        if not self.bpe:
            return True
        after = self.follows.get(left)
        if after is None:
            after = self.follows[left] = {}
        known = after.get(right)
        if known is None:
            self.judged += 1
            if self.judged > PAIRS:
                self.judged = 0
                self.follows.clear()
            known = after[right] = self.stay(left, right) if left else self.merged(right) == [right]
        return known

    def stay(self, left: str, right: str) -> bool:
        """Whether merging the characters of both from scratch ends with these two.

        Undoes the merges of both, the latest first, and looks at the two pieces that meet in the
        middle at each time: they must not make a piece that would have been merged before.
        """
        if MARK + MARK in left + right:  # scores of blank pieces tie, so undoing has no order
            return self.merged(left + right) == [left, right]
        limit = MINUS
        while True:
            got = self.ids.get(left + right)
            if got is not None and (self.score[got] > limit or limit == MINUS):
                return False
            a, b = self.undone(left), self.undone(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] < b[2]):
                limit, left = a[2], a[1]
            else:
                # a merge of equal score further left goes first
                limit, right = np.nextafter(b[2], MINUS), b[0]

    def undone(self, piece: str) -> tuple[str, str, float] | None:
        """The last merge that makes a piece: its two parts and its score; None for a single character."""
        if piece not in self.last:
            part, found = list(piece), None
            while len(part) > 1:
                best, at = max((self.score[i], -k) for k in range(len(part) - 1) if (i := self.ids.get(part[k] + part[k + 1])) is not None)
                found = part[-at], part[-at + 1], best
                part[-at : -at + 2] = [part[-at] + part[-at + 1]]
            self.last[piece] = found
        return self.last[piece]

    def parted(self, text: str, p: int) -> bool:
        """Whether no piece reaches over p, so that there is a single state."""
        return not 0 < p < len(text) or text[p - 1 : p + 1] not in self.near

    def states(self, text: str, p: int) -> list[State]:
        """The states at a cut: nodes that cover the character before it, or the single one."""
        if self.parted(text, p):
            return [(p, "")]
        return [(s, node) for s in range(max(0, p - self.longest), p) for node in self.nodes_at(text, s) if s + len(node) >= p]

    def step(self, text: str) -> tuple[str, tuple[str, ...]]:
        """The longest end of a text that begins a piece, and the nodes that end the text, the longest first."""
        if len(self.steps) >= PAIRS:
            self.steps.clear()
            self.ending.clear()
        tail = text
        while tail and tail not in self.starts:
            tail = tail[1:]
        nodes = self.ending.get(tail or text[-1])
        if nodes is None:
            nodes = self.ending[tail or text[-1]] = (*(tail[k:] for k in range(len(tail) - 1) if tail[k:] in self.ids), text[-1])
        self.steps[text] = tail, nodes
        return tail, nodes

    def forward(self, text: str, entry: State, end: int) -> tuple[int, list[str | None], list[float]]:
        """One row of a transfer matrix: from one state the best node that ends at each place, and its weight.

        Returns the place where the state's node ends, and from there on nodes and weights; a place
        without a path has None. For merges at most one node ends at a place, so the first found is it.
        """
        self.rows += 1
        begin = entry[0] + len(entry[1])
        steps, follows, none, bpe = self.steps, self.follows, {}, self.bpe
        last: list[str | None] = [entry[1]]
        weight = [0.0]
        tails = [""]  # what each place's text ends with that begins a piece: the nodes that end there are its ends
        if entry == (0, ""):  # a row depends on what lies before a place alone, so it goes on from the one before
            old, last, weight, tails = self.before
            same = min(end, len(last) - 1)
            while not text.startswith(old[:same]):
                same -= 1
            del last[same + 1 :], weight[same + 1 :], tails[same + 1 :]
            self.before = text, last, weight, tails
        tail = tails[-1]
        for e in range(begin + len(last), end + 1):
            seen = tail + text[e - 1]
            tail, found = steps.get(seen) or self.step(seen)
            best, top = None, MINUS
            for node in found:
                at = e - len(node) - begin
                left = last[at]
                if left is None:
                    continue
                if bpe:
                    stands = follows.get(left, none).get(node)
                    if self.may_follow(left, node) if stands is None else stands:
                        best, top = node, 0.0
                        break
                elif (w := weight[at] + self.weight(node)) > top:
                    best, top = node, w
            last.append(best)
            weight.append(top)
            tails.append(tail)
        return begin, last, weight

    def path(self, text: str, entry: State, leave: State) -> list[str]:
        """The nodes of the best path from one state to another, the latter's own included."""
        if entry == leave:
            return []
        begin, last, _ = self.forward(text, entry, leave[0])
        out, at = [leave[1]] if leave[1] else [], leave[0] - begin
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def row(self, text: str, entry: State, leaving: list[State], end: int) -> np.ndarray:
        """The best weights from one state to each state at ``end``."""
        out = np.full(len(leaving), MINUS)
        begin, last, weight = self.forward(text, entry, max(s for s, _ in leaving))
        for j, (s, node) in enumerate(leaving):
            if (s, node) == entry or (not node and begin == s):
                out[j] = 0.0  # the node that enters also leaves
            elif not node:
                out[j] = weight[s - begin]
            elif s >= begin and last[s - begin] is not None and self.may_follow(last[s - begin], node):
                out[j] = weight[s - begin] + self.weight(node)
        return out

    def inner(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and last place of a chunk with a single state, if there is any."""
        first = next((p for p in range(begin, end + 1) if self.parted(text, p)), None)
        return None if first is None else (first, next(p for p in range(end, begin - 1, -1) if self.parted(text, p)))

    def matrix(self, text: str, begin: int, end: int) -> np.ndarray:
        """The transfer matrix of the chunk [begin, end): best weights from each state at its left cut

        to each at its right cut, over the nodes that start in it. ``text`` must reach ``longest``
        characters over the chunk on either side, or as far as the whole text does.
        """
        self.matrices += 1
        entering, leaving, cut = self.states(text, begin), self.states(text, end), self.inner(text, begin, end)
        if cut is None:
            return np.array([self.row(text, x, leaving, end) for x in entering])
        first, last = cut
        column = np.array([self.row(text, x, [(first, "")], first)[0] for x in entering])
        between = 0.0 if self.bpe else sum(self.row(u, (0, ""), [(len(u), "")], len(u))[0] for u in self.unit.findall(text, first, last))
        return (column + between)[:, None] + self.row(text, (last, ""), leaving, end)

    def trace(self, text: str, begin: int, end: int, entry: State, leave: State) -> bytes:
        """The ids of the best path's nodes that start in the chunk [begin, end), as 32-bit numbers in a row."""
        cut = self.inner(text, begin, end)
        if cut is None:
            return self.numbers(self.path(text, entry, leave))
        first, last = cut
        head, tail = self.path(text, entry, (first, "")), self.path(text, (last, ""), leave)
        return self.numbers(head) + b"".join(map(self.words.__getitem__, self.unit.findall(text, first, last))) + self.numbers(tail)

    def scan(self, text: str, chunk: int = CHUNK) -> list[str]:
        """The nodes of the best path through one word, cut into chunks if it is long."""
        if len(text) <= chunk + chunk // 2:
            return self.path(text, (0, ""), (len(text), ""))
        cuts = [*range(0, len(text) - chunk // 2, chunk), len(text)]
        ends = list(zip(cuts, cuts[1:], strict=False))
        chosen = chosen_states([self.matrix(text, a, z) for a, z in ends])
        at = [self.states(text, p)[i] for p, i in zip(cuts, chosen, strict=True)]
        return [node for x, y in zip(at, at[1:], strict=False) for node in self.path(text, x, y)]

    def numbers(self, nodes: list[str]) -> bytes:
        """Ids of nodes, as 32-bit numbers in a row."""
        return b"".join([self.number.get(node) or self.spelled(node) for node in nodes])

    def spelled(self, node: str) -> bytes:
        """The ids of a character that is no piece."""
        return np.array([self.bytes[x] for x in node.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown], np.int32).tobytes()

    def word(self, text: str) -> bytes:
        """The ids of one word, a chunk with a single state at either end."""
        return self.numbers(self.scan(text.replace(" ", MARK)))

    def marked(self, text: str) -> str:
        """A text as pieces spell it: blanks as marks, one in front."""
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return next(self.encoded([text]))

    def encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of whole texts. Their new words are scanned in order, so that beginnings are scanned once."""
        # blanks stay blanks here: strings of Latin letters alone take less memory
        found = [self.unit.findall(" " + t if self.prefix and t else t) for t in texts]
        wanted = set().union(*found)
        new = wanted.difference(self.words)
        if len(self.words) + len(new) > WORDS // 2:
            self.words.turn()
            new = wanted
        for w in sorted(new):
            self.words[w]
        for own in found:
            yield np.frombuffer(b"".join(map(self.words.__getitem__, own)), np.int32)

    def chunks(self, text: str, size: int) -> Iterator[tuple[int, str, int, int]]:
        """(number, window, begin, end) of the chunks of a text of any length, each with its surroundings."""
        text = self.marked(text)
        for k, a in enumerate(range(0, len(text), size)):
            z, low = min(len(text), a + size), max(0, a - self.longest)
            yield k, text[low : z + self.longest], a - low, z - low

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; byte pieces in a row are read as UTF-8, bad ones as U+FFFD."""
        text = b"".join(map(self.written.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def units(pieces) -> re.Pattern:
    """A pattern of the chunks that have a single state at either end.

    No piece reaches over their bounds: before a word start (but within a run of them), on either side
    of a character that stands in no longer piece, and where a sign follows a letter that no piece has
    in front of a sign.
    """
    near = {(x, y) for p in pieces for x, y in zip(p, p[1:], strict=False)}
    known = {c for pair in near for c in pair} - {MARK}
    signs = {c for c in known if not c.isalnum()}
    before = {x for x, y in near if y in signs and x not in signs and x != MARK}
    alone = "".join(c for c in map(chr, range(1, 128)) if c not in known and c != " ")
    one, sign, held = (f"[{re.escape(c)}]" if c else r"(?!)" for c in (alone, "".join(sorted(signs)), "".join(sorted(before))))
    rest = f"[^ {MARK}{re.escape(alone + ''.join(sorted(signs)))}]"
    more = f"(?:(?<={held})(?:{sign})+{rest}*)*"
    return re.compile(f"{one}|[ {MARK}]+(?:{sign})*{rest}*{more}|(?:{sign})+{rest}*{more}|{rest}+{more}")


class Words(dict):
    """Ids by word, made when asked for; long words are not kept.

    A turn puts the words aside: those asked for again come back, the others go at the next turn.
    """

    def __init__(self, made):
        self.made = made
        self.aside: dict[str, bytes] = {}

    def turn(self) -> None:
        self.aside = dict(self)
        self.clear()

    def __missing__(self, text: str) -> bytes:
        ids = self.aside.get(text)
        if ids is None:
            ids = self.made(text)
        if len(text) <= 64:
            self[text] = ids
        return ids


@lru_cache(2)
def loaded(raw: bytes) -> Pieces:
    return Pieces(raw)


def combined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The associative product: the best weight over all states at the cut between."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def chosen_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut on the best path, one more than there are chunks.

    Matrices are combined pairwise up a tree; back down, each node is told the states at its ends and
    picks the one between its halves.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([combined(*own[i : i + 2]) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)])
    root = levels[-1][0]
    ends = list(map(int, np.unravel_index(np.argmax(root), root.shape)))
    for own in levels[-2::-1]:
        below = []
        for i, entry in enumerate(ends[:-1]):
            below.append(entry)
            if 2 * i + 1 < len(own):
                below.append(int(np.argmax(own[2 * i][entry] + own[2 * i + 1][:, ends[i + 1]])))
        ends = [*below, ends[-1]]
    return ends


CHUNKS = "`_row` long, `_part` int, `_window` string, `_begin` int, `_end` int"


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), part: int = PART) -> DataFrame:
    """Ids of every whole text: ``keep`` columns, doc_id, ids (array of int) and n_tokens.

    A null or empty text has no ids. Repeated rows keep their number, null ids stay null, an empty
    table gives no rows. Columns outside ``keep`` are left out. Texts of more than ``part`` characters
    are cut into chunks that are rows of their own: each yields its matrix, a document's matrices tell
    the states at its cuts, and each chunk is traced between two of them; the others stay in place.
    ``model`` is the file's content; it reaches the executors once. The ids equal the library's.
    ``docs`` must be a table that rereads alike, as giant texts are told apart by their place in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c) for c in keep if c != "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for b in slices(batches):
            at = b.schema.get_field_index("_text")
            out = lists(list(pieces.encoded(b.column(at).to_pylist())))
            cols = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, out], names=[*(n for i, n in enumerate(b.schema.names) if i != at), "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for b in batches:
            for row, text in zip(b.column(0), b.column(1), strict=True):
                for k, window, a, z in pieces.chunks(text.as_py(), part):
                    kinds = pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()
                    made = [pa.array([x], kind) for x, kind in zip((row.as_py(), k, window, a, z), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(made, names=["_row", "_part", "_window", "_begin", "_end"])

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for b in batches:
            made = [pieces.matrix(w, a, z) for w, a, z in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            cols = [pa.array([len(m) for m in made], pa.int32()), pa.array([m.ravel().tolist() for m in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["_row", "_part", "_states", "_weights"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        chosen = chosen_states([np.asarray(w, float).reshape(n, -1) for w, n in zip(pdf["_weights"], pdf["_states"], strict=True)])
        return pdf.assign(_entry=chosen[:-1], _leave=chosen[1:])[["_row", "_part", "_entry", "_leave"]]

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for b in batches:
            ids = []
            for w, a, z, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
                ids.append(np.frombuffer(pieces.trace(w, a, z, pieces.states(w, a)[x], pieces.states(w, z)[y]), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(ids)], names=["_row", "_part", "ids"])

    small = own.where(F.length("_text") <= part)
    done = small.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema if f.name != "_text"), "ids array<int>"]))
    large = own.where(F.length("_text") > part).withColumn("_row", F.monotonically_increasing_id())
    # what the join below asks for is asked here already, so that both uses read one exchange
    chunks = large.select("_row", "_text").mapInArrow(cut, CHUNKS).where("_row IS NOT NULL AND _part IS NOT NULL").repartition("_row", "_part")
    states = chunks.mapInArrow(transfer, "`_row` long, `_part` int, `_states` int, `_weights` array<double>").groupBy("_row").applyInPandas(choose, "`_row` long, `_part` int, `_entry` int, `_leave` int")
    traced = chunks.join(states, ["_row", "_part"]).select("_row", "_part", "_window", "_begin", "_end", "_entry", "_leave").mapInArrow(trace, "`_row` long, `_part` int, ids array<int>")
    coded = traced.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "ids"))), lambda x: x["ids"])).alias("ids"))
    joined = large.drop("_text").join(coded, "_row").drop("_row")
    return done.unionByName(joined).withColumn("n_tokens", F.size("ids").cast("long"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``SLICE`` bytes of text each."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(b.schema.get_field_index("_text"))).to_numpy(zero_copy_only=False)) // SLICE
        cuts = [0, *np.flatnonzero(np.diff(size)) + 1, b.num_rows]
        yield from (b.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False) if z > a)


def lists(ids: list[np.ndarray]) -> pa.Array:
    """Arrays of numbers as a column of lists."""
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The text of every row's ids: ``keep`` columns and text. Null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    own = rows.select(F.col(ids_col).alias("_ids"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for b in batches:
            texts = [pieces.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*b.schema.names[1:], "text"])

    return own.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "_ids"), "text string"]))


def read_model(path: str = MODEL) -> bytes:
    """The model file, read where the driver runs; its size, some hundred KB, bounds the broadcast."""
    with open(path, "rb") as f:
        return f.read()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document's ids, with doc_id, lang and source."""
    return encode(docs, read_model(model), keep=("lang", "source"))


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document encoded, and whether its decoded ids give the text back."""
    raw = read_model(model)
    docs = table(spark, sf_dir, "documents")
    coded = encode(docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")), raw, keep=("text_sha256",))
    back = decode(coded, raw, keep=("doc_id", "ids", "n_tokens", "text_sha256"))
    return back.select("doc_id", "n_tokens", "ids", (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


#: Merges are beyond SQL: tested against the sentencepiece library and by exact round trips.
ORACLE_SQL = None
