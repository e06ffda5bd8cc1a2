"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks a text once and keeps, for each boundary, the best path that ends there: its last piece and the boundary before.
Only boundaries within the longest piece of the current place can still be extended, so once the paths of all of those run
through one common boundary, the ids up to it are final; they are committed and the window before it is forgotten.

What makes a path best depends on the model. Unigram models add the pieces' scores. In merge (BPE) models a sequence of pieces is
the result of the merges if, and only if, each two neighbours are the result of the merges for the text of the two; scores of
transitions are thus 0 or minus infinity, and exactly one path survives at each boundary. Ids equal the library's for both kinds.

Places where no piece of the vocabulary has the two characters around it are boundaries of every path. A batch of texts is cut at
all of them at once, as arrays; each distinct fragment of the batch is searched once, and the ids of the short ones are kept in a
bounded cache. A fragment may still be as long as its text; the search's window bounds the memory then.

Scale: rows are independent; the model (its bytes, some hundred kilobytes) is the only thing broadcast. Batches are bounded in rows
and in bytes of text, caches in entries of bounded length.

Defined results
---------------
* Null and empty texts have no ids and decode to an empty text. Very long texts are searched in the same bounded window.
* Characters outside the vocabulary become byte pieces where the model has them, else the unknown id, once for a run of them.
* Null ids and ids outside the vocabulary decode as the unknown piece; bytes that aren't UTF-8 decode as replacement characters.
* A text that has the space mark U+2581 itself decodes to spaces, as with the library; such texts don't round-trip.
* Models with a character map or user-defined symbols are refused: their normalisation is not built here.
* Extra columns pass through; a column with the output's name is replaced.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters below this have a row of their own in the table of pairs; the space mark has one, and all others share one.
OWN_ROWS = 0x600
BATCH_ROWS, BATCH_BYTES, STRETCH = 1 << 14, 4 << 20, 1 << 17
#: Pairs of pieces whose relation is remembered.
KNOWN_PAIRS = 1 << 18


def wire_fields(data: bytes):
    """(number, value) of a protocol buffer message: integers, and bytes for nested fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and settings of a model file's bytes, and the search over them."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
    UNIGRAM, BPE = 1, 2

    def __init__(self, data: bytes, cache_words: int = 100_000, cache_chars: int = 48):
        self.kind, self.prefix, self.squeeze, self.unknown = self.UNIGRAM, True, True, 0
        pieces = []
        for number, value in wire_fields(data):
            if number == 1:
                piece = dict(wire_fields(value))
                score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                pieces.append((piece.get(1, b"").decode(), score, piece.get(3, self.NORMAL)))
            elif number == 2:
                self.kind = dict(wire_fields(value)).get(3, self.UNIGRAM)
            elif number == 3:
                spec = dict(wire_fields(value))
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
        if self.kind not in (self.UNIGRAM, self.BPE) or any(k == self.USER for _, _, k in pieces):
            raise ValueError("only unigram and BPE models without user-defined symbols are supported")
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == self.NORMAL}
        self.scores = [s for _, s, _ in pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == self.BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == self.UNKNOWN), 0)
        self.text = [p for p, _, _ in pieces]
        self.longest = max(map(len, self.ids), default=1)
        lowest = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.unknown_score = lowest - 10.0
        self.bytes = [self._bytes(p, k) for p, _, k in pieces]
        self.joined: np.ndarray | None = None  # what only the search needs is made by the first one
        self.table = pa.array(self.bytes, pa.binary())
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known: dict[int, bool] = {}
        self.cache_words, self.cache_chars = cache_words, cache_chars

    def _pairs(self) -> np.ndarray:
        """Whether a piece may hold two characters next to each other, by their rows."""
        joined = np.zeros((OWN_ROWS + 2, OWN_ROWS + 2), bool)
        joined[-1, -1] = True
        for piece in self.ids:
            rows = self._rows(np.frombuffer(piece.encode("utf-32-le"), np.uint32))
            joined[rows[:-1], rows[1:]] = True
        if not self.byte_ids:  # a run of unknown characters is one id
            single = np.array([c < OWN_ROWS and chr(c) not in self.ids for c in range(OWN_ROWS)] + [False, True])
            joined |= single[:, None] & single
        return joined

    @staticmethod
    def _rows(chars: np.ndarray) -> np.ndarray:
        return np.where(chars < OWN_ROWS, chars, np.where(chars == ord(MARK), OWN_ROWS, OWN_ROWS + 1)).astype(np.int32)

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == self.BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == self.UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == self.CONTROL else piece.replace(MARK, " ").encode()

    # Merge models: whether two pieces stay apart.

    def _prepare_merges(self) -> None:
        """rank: the order of merging, -1 for single characters. left, right: the pieces of a piece's last merge. joint: the piece that
        two pieces make. usable: pieces that merging makes of their own text; others are on no path."""
        n, ids = len(self.text), self.ids
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in ids.values()}, reverse=True))}
        self.rank, self.left, self.right, self.joint, self.usable = [-1] * n, [-1] * n, [-1] * n, {}, {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                if (a := ids.get(piece[:k])) is not None and (b := ids.get(piece[k:])) is not None:
                    self.joint[a * n + b] = i
            if len(piece) > 1:
                self.rank[i] = order[self.scores[i]]
        for piece, i in ids.items():
            parts = [ids.get(c, -1) for c in piece]
            while len(parts) > 1:
                best, at = min((self.rank[j], k) if (j := self.joint.get(parts[k] * n + parts[k + 1], -1)) >= 0 and min(parts[k : k + 2]) >= 0 else (n, k) for k in range(len(parts) - 1))
                if best == n:
                    break
                self.left[i], self.right[i] = parts[at], parts[at + 1]
                parts[at : at + 2] = [self.joint[parts[at] * n + parts[at + 1]]]
            if len(parts) == 1:
                self.usable[piece] = i
        # The longest usable piece by its last three characters (two for pieces of two): no longer ones need to be looked up there.
        self.reach: dict[str, int] = {}
        for piece in self.usable:
            self.reach[piece[-3:]] = max(self.reach.get(piece[-3:], 1), len(piece))

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the text of the pieces a and b gives a and b; both are results of merging themselves.

        Undo the later of the two last merges again and again: a merge across the border would have come first if its rank is
        before that of the merge just undone (of equal ranks the left one comes first).
        """
        n, rank, joint, left_undone = len(self.text), self.rank, self.joint, False
        limit = n
        while True:
            j = joint.get(a * n + b)
            if j is not None and (rank[j] < limit or (rank[j] == limit and not left_undone)):
                return False
            one, two = rank[a], rank[b]
            if one > two:
                limit, left_undone, a = one, True, self.right[a]
            elif two >= 0:
                limit, left_undone, b = two, False, self.left[b]
            else:
                return True

    # The search.

    def merge_step(self, text: str, at: int, end: int, last: list[int | None], base: int) -> tuple[int, int | None]:
        """The one path to end in a merge model: the boundary before its last piece, and that piece (None: unknown)."""
        usable, reach = self.usable, self.reach
        far = (end > 2 and reach.get(text[end - 3 : end])) or (2 if end > 1 and text[end - 2 : end] in reach else 1)
        for start in range(max(at, end - far), end):
            piece = usable.get(text[start:end])
            if piece is not None:
                before = last[start - base]
                if before is None:
                    return start, piece
                pair = before * len(self.text) + piece
                whole = self.known.get(pair)
                if whole is None:
                    if len(self.known) >= KNOWN_PAIRS:
                        self.known.clear()
                    whole = self.known[pair] = self.apart(before, piece)
                if whole:
                    return start, piece
        return end - 1, None

    def score_step(self, text: str, at: int, end: int, score: list[float], base: int) -> tuple[int, int | None, float]:
        """The best path to end in a unigram model, and its score; of equal scores the earliest boundary."""
        best = (end - 1, None, score[end - 1 - base] + self.unknown_score)
        for start in range(at, end):
            i = self.ids.get(text[start:end])
            if i is not None and ((total := score[start - base] + self.scores[i]) > best[2] or (best[1] is None and total == best[2])):
                best = (start, i, total)
        return best

    def segments(self, text: str, back: list[int], last: list[int | None], score: list[float]):
        """Runs of final (id, text), as they are committed; unknown characters have no id.

        back, last and score are of the boundaries whose paths are known already; they are added to until the first commit.
        """
        base, n, longest, merging = 0, len(text), self.longest, self.kind == self.BPE
        for end in range(len(back), n + 1):
            at = end - longest if end - base > longest else base
            if merging:
                start, piece = self.merge_step(text, at, end, last, base)
            else:
                start, piece, total = self.score_step(text, at, end, score, base)
                score.append(total)
            back.append(start)
            last.append(piece)
            if end % longest and end < n:
                continue
            live = {end} if end == n else set(range(max(base, end - longest + 1), end + 1))
            while len(live) > 1:
                top = max(live)
                live.remove(top)
                live.add(back[top - base])
            meet = live.pop()
            if meet > base:
                run, place = [], meet
                while place > base:
                    run.append((last[place - base], text[back[place - base] : place]))
                    place = back[place - base]
                yield run[::-1]
                back, last, score = back[meet - base :], last[meet - base :], score[meet - base :]
                base = meet

    def short_segments(self, text: str, back: list[int], last: list[int | None], score: list[float]) -> list[tuple[int | None, str]]:
        """segments() of a text within one window: the whole of it is committed at its end."""
        n, merging = len(text), self.kind == self.BPE
        for end in range(len(back), n + 1):
            if merging:
                start, piece = self.merge_step(text, 0, end, last, 0)
            else:
                start, piece, total = self.score_step(text, 0, end, score, 0)
                score.append(total)
            back.append(start)
            last.append(piece)
        run, place = [], n
        while place:
            start = back[place]
            run.append((last[place], text[start:place]))
            place = start
        return run[::-1]

    def searched(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word as int32 bytes. The path to a boundary depends on the text before it alone, so that in order of
        the words each goes on from the prefix that it shares with the one before."""
        found, before, state = {}, "", ([0], [None], [0.0])
        for word in sorted(words):
            shared = next((k for k, (a, b) in enumerate(zip(word, before)) if a != b), min(len(word), len(before)))
            keep = min(shared + 1, len(state[0]), len(word))
            for known in state:
                del known[keep:]
            out = []
            for run in [self.short_segments(word, *state)] if len(word) <= self.longest else self.segments(word, *state):
                for piece, text in run:
                    if piece is not None:
                        out.append(piece)
                    elif self.byte_ids:
                        out += [self.byte_ids[b] for b in text.encode()]
                    elif not out or out[-1] != self.unknown:
                        out.append(self.unknown)
            found[word], before = array("i", out).tobytes(), word
        return found

    def fragment_ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct fragments as int32 bytes; those of short ones are remembered."""
        cache, older = self.cache, self.older
        new = self.searched([w for w in words if w not in cache and w not in older])
        found = [cache.get(w) or older.get(w) or new[w] for w in words]
        if len(cache) + len(new) > self.cache_words:  # fragments that come again live on in the next generation
            self.older, self.cache = cache, {w: f for w, f in zip(words, found) if len(w) <= self.cache_chars}
        else:
            cache.update((w, f) for w, f in new.items() if len(w) <= self.cache_chars)
        return found

    def forget(self) -> None:
        """Drop what is remembered; a Python worker lives on after its task, beside the next stages' workers."""
        self.cache, self.older, self.known = {}, {}, {}

    def normalised(self, texts: pa.Array) -> pa.Array:
        """Texts with space marks for spaces; null texts are empty."""
        texts = pc.fill_null(texts, "")
        if self.squeeze:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(MARK, texts, ""))
        return pc.replace_substring(texts, " ", MARK)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of a batch of texts. Cuts, lists and lookups are array operations; only distinct fragments are searched."""
        if self.joined is None:
            self.joined = self._pairs()
            if self.kind == self.BPE:
                self._prepare_merges()
        texts = self.normalised(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or ends[0] == ends[-1]:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array(np.zeros(0, np.int32)))
        data = texts.buffers()[2][ends[0] : ends[-1]].to_pybytes()
        ends = ends - ends[0]
        chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        places, begins = np.zeros(len(chars) + 1, np.int32), np.ones(len(chars), bool)
        for at in range(0, len(chars), STRETCH):  # in stretches, as indices take many times the room of text
            part = chars[max(0, at - 1) : at + STRETCH]
            rows = self._rows(part)
            begins[max(1, at) : at + STRETCH] = ~self.joined[rows[:-1], rows[1:]]
            part = chars[at : at + STRETCH]
            sizes = 1 + (part > 0x7F).view(np.uint8) + (part > 0x7FF) + (part > 0xFFFF)
            places[at + 1 : at + 1 + len(part)] = np.cumsum(sizes, dtype=np.int32) + places[at]
        text_begins = np.searchsorted(places, ends)
        begins[text_begins[text_begins < len(chars)]] = True
        starts = np.flatnonzero(begins)
        cuts = np.append(places[starts], len(data)).astype(np.int32)
        fragments = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        found = self.fragment_ids(fragments.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(found), np.int32)
        sizes = np.array([len(x) >> 2 for x in found], np.int64)
        which = fragments.indices.to_numpy()
        counts, at = sizes[which], (np.cumsum(sizes) - sizes)[which]
        stops = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(at - stops[:-1], counts) + np.arange(stops[-1])]
        return pa.ListArray.from_arrays(pa.array(stops[np.searchsorted(starts, text_begins)].astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of a batch of ids: the bytes of all pieces in one take, cut at the ends of the lists."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(ids.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        flat = np.where((flat < 0) | (flat >= len(self.bytes)), self.unknown, flat)
        pieces = self.table.take(pa.array(flat, pa.int64()))
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        ends = ends[np.concatenate([[0], np.cumsum(sizes)])]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[: ends[-1]] if len(flat) and pieces.buffers()[2] else np.zeros(0, np.uint8)
        if self.prefix:  # the space before the first word goes
            first = ends[:-1][ends[:-1] < ends[1:]]
            first = first[data[first] == 0x20]
            ends = ends - np.searchsorted(first, ends)
            data = np.delete(data, first)
        out = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes()))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([x.decode("utf-8", "replace") for x in out.cast(pa.binary()).to_pylist()], pa.string())
        return out


#: Models that this Python worker has loaded, by the SHA-256 of their bytes. They stay from task to task, their caches don't.
_loaded: dict[str, Model] = {}


def load(data: bytes, key: str | None = None) -> Model:
    key = key or hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded[key] = Model(data)
    return _loaded[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _pieces(batch: pa.RecordBatch, column: int):
    """Parts of a batch of at most BATCH_ROWS rows, and of about BATCH_BYTES in a column if no row is longer."""
    start = 0
    while start < batch.num_rows or not batch.num_rows:
        rows = min(BATCH_ROWS, batch.num_rows - start)
        while rows > 1 and batch.column(column).slice(start, rows).nbytes > BATCH_BYTES:
            rows = (rows + 1) // 2
        yield batch.slice(start, rows)
        start += rows
        if not batch.num_rows:
            return


def _mapped(df: DataFrame, column: str, added: dict[str, T.DataType], model_path: str, make) -> DataFrame:
    """df with the columns make(model, column) gives, in small batches, as texts may be very long. The driver reads the model."""
    df = df.drop(*(set(added) - {column}))
    place = df.columns.index(column)
    bytes_of_model = read_model(model_path)
    key = hashlib.sha256(bytes_of_model).hexdigest()
    data = df.sparkSession.sparkContext.broadcast(bytes_of_model)

    def run(batches):
        model = _loaded.get(key) or load(data.value, key)
        try:
            for batch in (part for whole in batches for part in _pieces(whole, place)):
                columns = dict(zip(batch.schema.names, batch.columns)) | dict(zip(added, make(model, batch.column(place))))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        finally:
            model.forget()

    fields = {f.name: f for f in df.schema.fields} | {c: T.StructField(c, t) for c, t in added.items()}
    return df.mapInArrow(run, T.StructType(list(fields.values())))


IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, text: str = "text", out: str = "ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """df with the ids of its texts."""
    return _mapped(df, text, {out: IDS}, model_path, lambda model, texts: [model.encode(texts.cast(pa.string()))])


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """df with the texts of its ids; a null array is an empty text."""
    return _mapped(df, ids, {out: T.StringType()}, model_path, lambda model, lists: [model.decode(lists)])


def encode_and_decode(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """decode(encode(df)) in one pass, so that a task needs one Python worker and the texts cross to it once."""

    def make(model, texts):
        found = model.encode(texts.cast(pa.string()))
        return [found, model.decode(found)]

    return _mapped(df, text, {ids: IDS, decoded: T.StringType()}, model_path, make)
