"""SentencePiece BPE encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import give_back, prefix_hash, quoted, slices, span_hash, utf8_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units whose ids a worker remembers at most, between batches and tasks: some 40 MB.
REMEMBERED = 1 << 20
#: Bytes of text taken at a time, and characters indexed at a time.
TAKEN, PORTION = 1 << 21, 1 << 18
#: Slots of the table of piece pairs that have been asked for.
PAIRS = 1 << 20
NONE = -1
NEVER = 1 << 40


class Vocabulary:
    """The pieces of a BPE model and what encoding needs of them. Pieces hold white space at their start only."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i) for i in ids]
        self.byte = {i: int(self.text[i][3:5], 16) for i in ids if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.skipped = {i for i in ids if sp.is_control(i) or sp.is_unknown(i)}
        raw = [b"" if i in self.skipped else bytes([self.byte[i]]) if i in self.byte else self.text[i].replace(SPACE, " ").encode() for i in ids]
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at, self.raw = np.cumsum(self.raw_len) - self.raw_len, np.frombuffer(b"".join(raw), np.uint8)
        plain = [i for i in ids if i not in self.byte and i not in self.skipped]
        self.runs = {len(self.text[i]): i for i in plain if set(self.text[i]) == {SPACE}}
        normal = [i for i in plain if not self.text[i].startswith(SPACE * 2)]
        self.score = {self.text[i]: sp.get_score(i) for i in normal}
        self.id_of = {self.text[i]: i for i in normal}
        self.longest = max(map(len, self.id_of), default=1)
        order = sorted(self.id_of)  # code point order
        self.sorted_ids = np.array([self.id_of[t] for t in order], np.int64)
        self.sorted_len = np.array([len(t) for t in order], np.int64)
        self.points = np.zeros((len(order), self.longest), np.int64)  # code points plus 1; 0 behind the end
        for k, t in enumerate(order):
            self.points[k, : len(t)] = [ord(c) + 1 for c in t]
        # Byte pairs that stand at a character boundary inside a piece: between all others a text can be cut.
        self.joins = np.zeros((256, 256), bool)
        for i in plain:
            b = self.text[i].replace(SPACE, " ").encode()
            for x, y in zip(b, b[1:], strict=False):
                self.joins[x, y] |= y & 0xC0 != 0x80
        self._merges(normal)
        self.known, self.known_at, self.known_n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)
        self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def _merges(self, normal: list[int]) -> None:
        """How each piece comes about: its rank among merges (0: a character), its last merge, and which pairs make which rank."""
        ranks = {x: k for k, x in enumerate(sorted({-self.score[self.text[i]] for i in normal}), 1)}
        n = len(self.text)
        self.rank, self.left, self.right = np.zeros(n, np.int64), np.arange(n), np.arange(n)
        self.orderly = np.zeros(n, bool)  # made by merges of rising rank and by nothing else
        keys: dict[int, int] = {}
        for i in normal:
            t = self.text[i]
            for k in range(1, len(t)):
                if (a := self.id_of.get(t[:k])) is not None and (b := self.id_of.get(t[k:])) is not None:
                    keys[a << 20 | b] = ranks[-self.score[t]]
            steps = self.steps(t)
            if len(steps) and steps[-1][2] == t or len(t) == 1:
                told = [ranks[-self.score[x[2]]] for x in steps]
                self.orderly[i] = told == sorted(told)
            if len(t) > 1 and self.orderly[i]:
                self.rank[i], self.left[i], self.right[i] = told[-1], self.id_of.get(steps[-1][0], i), self.id_of.get(steps[-1][1], i)
                self.orderly[i] = steps[-1][0] in self.id_of and steps[-1][1] in self.id_of
        self.pair_keys = np.array(sorted(keys), np.int64)
        self.pair_rank = np.array([keys[k] for k in self.pair_keys.tolist()], np.int64)

    def steps(self, text: str) -> list[tuple[str, str, str]]:
        """The merges (left, right, both) of plain BPE: join the best-scored neighbours, leftmost first, until none is a piece."""
        parts, out = list(text), []
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if (made := parts[best] + parts[best + 1]) not in self.score:
                break
            out.append((parts[best], parts[best + 1], made))
            parts[best : best + 2] = [made]
        return out

    def stays_apart(self, left: int, right: int) -> bool:
        """Does plain BPE of the two pieces' text end with these two pieces?"""
        a, b = self.text[left], self.text[right]
        parts = list(a + b)
        for x, y, made in self.steps(a + b):
            at = next(k for k in range(len(parts) - 1) if parts[k] == x and parts[k + 1] == y)
            parts[at : at + 2] = [made]
        return parts == [a, b]

    def adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """May the right piece follow the left one? Only if BPE leaves the two as they are when they stand alone."""
        asked = left << 20 | right
        slot = (asked * 0x9E3779B97F4A7C1 >> 24) & (PAIRS - 1)
        missing = np.flatnonzero(self.pair_key[slot] != asked)
        out = self.pair_ok[slot]
        if len(missing):
            new, back = np.unique(asked[missing], return_inverse=True)
            ok = self._apart(new >> 20, new & 0xFFFFF)
            out[missing] = ok[back]
            place = (new * 0x9E3779B97F4A7C1 >> 24) & (PAIRS - 1)
            self.pair_key[place], self.pair_ok[place] = new, ok
        return out

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """stays_apart() of many pairs at once.

        Merges happen in order of rank, so the two pieces are undone from the last merge back. At each point the neighbours
        across the border must not make a piece of lower rank than the merge that takes either of them away; of equal ranks
        the left one comes first. Pieces of disorderly making are left to plain BPE.
        """
        ok = np.ones(len(left), bool)
        plain = np.flatnonzero(~(self.orderly[left] & self.orderly[right]))
        ok[plain] = [self.stays_apart(a, b) for a, b in zip(left[plain].tolist(), right[plain].tolist(), strict=True)]
        at = np.flatnonzero(self.orderly[left] & self.orderly[right])
        x, y = left[at], right[at]
        over_x, over_y = np.full(len(at), NEVER), np.full(len(at), NEVER)
        while len(at):
            place = np.minimum(np.searchsorted(self.pair_keys, x << 20 | y), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[place] == x << 20 | y, self.pair_rank[place], NEVER + 1)
            bad = (rank < over_x) & (rank <= over_y)
            ok[at[bad]] = False
            open_ = ~bad & ((self.rank[x] > 0) | (self.rank[y] > 0))
            at, x, y, over_x, over_y = (v[open_] for v in (at, x, y, over_x, over_y))
            first = self.rank[x] > self.rank[y]  # the left one was made last
            over_x, over_y = np.where(first, self.rank[x], over_x), np.where(first, over_y, self.rank[y])
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of hashes among the remembered ones."""
        place = np.searchsorted(self.known, hashes)
        return place, np.append(self.known, np.uint64(0))[place] == hashes if len(self.known) else np.zeros(len(hashes), bool)

    def remember(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """hashes are new and sorted."""
        n = np.array([len(x) >> 2 for x in ids], np.int64)
        known = np.append(self.known, hashes)
        order = np.argsort(known, kind="stable")  # two sorted runs: one merge
        self.known_at = np.append(self.known_at, len(self.pool) + np.cumsum(n) - n)[order]
        self.known, self.known_n = known[order], np.append(self.known_n, n)[order]
        self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<i4"))

    def forget(self) -> None:
        self.known, self.known_at, self.known_n, self.pool = self.known[:0], self.known_at[:0], self.known_n[:0], self.pool[:0]


@functools.cache
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def packed(symbols: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian symbols, eight bytes to an integer: comparing these in turn compares the texts."""
    per = 8 // symbols.itemsize
    wide = np.zeros((len(symbols), -(-symbols.shape[1] // per) * per), symbols.dtype.newbyteorder(">"))
    wide[:, : symbols.shape[1]] = symbols
    return [np.ascontiguousarray(wide[:, j : j + per]).view(">u8").ravel().astype(np.uint64) for j in range(0, wide.shape[1], per)]


def in_alphabet(v: Vocabulary, alphabet: np.ndarray, kind: type) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The pieces that the alphabet spells: their numbers and the least and greatest symbols that begin with them."""
    place = np.full(0x110001, -1, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    place[0] = 0
    at = place[v.points]
    spelled = np.flatnonzero((at >= 0).all(axis=1))
    symbols = at[spelled].astype(kind)
    behind = np.arange(v.longest) >= v.sorted_len[spelled, None]
    return spelled, packed(symbols), packed(np.where(behind, np.iinfo(kind).max, symbols).astype(kind))


def rank_in(keys: list[np.ndarray], asked: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of many texts at once in sorted texts: how many are smaller (or equal, if right)."""
    lo, hi = np.zeros(len(asked[0]), np.int64), np.full(len(asked[0]), len(keys[0]), np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        at = np.minimum(mid, len(keys[0]) - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, q in zip(keys, asked, strict=True):
            x = k[at]
            less |= same & (x < q)
            same &= x == q
        below = (less | (same & right)) & (lo < hi)
        lo, hi = np.where(below, mid + 1, lo), np.where(below | (lo >= hi), hi, mid)
    return lo


def encode_words(v: Vocabulary, words: list[str]) -> list[bytes]:
    """Ids of each word, by itself, as 32-bit integers.

    The batch's distinct words are one text; its suffixes are sorted as deep as the longest piece, every piece finds its range by binary
    search, and the ranges' positions are edges. Edges are sorted by their end and relaxed: an edge extends the encoding
    of the prefix before it if BPE leaves its piece and the prefix's last piece alone, which holds for one edge per end.
    """
    size = np.array([len(w) for w in words], np.int64)
    start = np.append(0, np.cumsum(size + 1)[:-1])
    points = np.frombuffer("\x00".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    points[start + size] = 0
    n = len(points)
    alphabet, symbols = np.unique(points, return_inverse=True)  # 0, the separator, is its first
    kind = np.uint8 if len(alphabet) < 255 else np.uint16 if len(alphabet) < 65535 else np.uint32
    deep = np.append(symbols, np.zeros(v.longest, np.int64)).astype(kind)
    view = np.lib.stride_tricks.sliding_window_view(deep, v.longest)[:n].copy()
    view *= np.minimum.accumulate(view != 0, axis=1)
    keys = packed(view)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    spelled, low, high = in_alphabet(v, alphabet, kind)
    lo, hi = rank_in(keys, low, False), rank_in(keys, high, True)
    count = hi - lo
    which = np.repeat(np.arange(len(count), dtype=np.int32), count)
    begin = order[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    piece, length = v.sorted_ids[spelled[which]], v.sorted_len[spelled[which]]
    # A character that no piece holds is an edge of its own; its bytes become the ids.
    single = np.zeros(n, bool)
    single[begin[length == 1]] = True
    lone = np.flatnonzero(~single & (points != 0))
    begin = np.append(begin, lone)
    piece = np.append(piece, np.full(len(lone), NONE))
    end = begin + np.append(length, np.ones(len(lone), np.int64))
    word = np.searchsorted(start, begin, side="right") - 1
    step = end - start[word]
    by_step = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
    begin, end, piece, step, word = begin[by_step], end[by_step], piece[by_step], step[by_step], word[by_step]
    bounds = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step))
    last = np.full(n + 1, -3, np.int64)  # the last piece of the prefix that ends here; NONE: an unknown character
    back = np.zeros(n + 1, np.int64)
    opens = begin == start[word]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        s, p = begin[a:b], piece[a:b]
        before = last[s]
        ok = opens[a:b] | (before == NONE) | ((p == NONE) & (before != -3))
        ask = np.flatnonzero(~ok & (before >= 0) & (p >= 0))
        if len(ask):
            ok[ask] = v.adjacent(before[ask], p[ask])
        e = end[a:b][ok]
        last[e], back[e] = p[ok], s[ok]
        # `last` of a word's first position would be read as the word before's end; words are a separator apart.
    # All words walk back from their ends together; what they pass, sorted by position, is their ids.
    at, floor = start + size, start
    passed = []
    while len(at):
        passed.append(back[at])
        at = back[at]
        more = at > floor
        at, floor = at[more], floor[more]
    where = np.sort(np.concatenate(passed)) if passed else np.empty(0, np.int64)
    taken = last[_end_of(where, start, size)]
    first = np.searchsorted(where, start)
    stop = np.append(first[1:], len(where))
    raw = taken.astype("<i4").tobytes()
    out = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
    for k in np.unique(np.searchsorted(start, where[taken == NONE], side="right") - 1).tolist():
        ids: list[int] = []
        for s, t in zip(where[first[k] : stop[k]].tolist(), taken[first[k] : stop[k]].tolist(), strict=True):
            ids += [t] if t >= 0 else [v.byte_id[x] for x in words[k][s - start[k]].encode("utf-8", "replace")]
        out[k] = np.array(ids, "<i4").tobytes()
    return out


def _end_of(where: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the pieces that begin at these sorted positions end: at the next one's begin, or the word's end."""
    word = np.searchsorted(start, where, side="right") - 1
    end = start[word] + size[word]
    follows = np.append(where[1:], -1)
    inside = np.append(word[1:] == word[:-1], False) if len(word) else np.empty(0, bool)
    return np.where(inside, follows, end)


def spaced(v: Vocabulary, unit: str, of: dict[str, bytes]) -> bytes:
    """Ids of a unit with several spaces before its word: one may belong to the word, the others are runs."""
    word = unit.lstrip(SPACE)
    n = len(unit) - len(word)
    ids = np.frombuffer(of[SPACE + word], "<i4") if word else np.empty(0, "<i4")
    if len(ids) and ids[0] == v.id_of[SPACE]:
        ids = ids[1:]
    elif len(ids):
        n -= 1
    most = max(v.runs)  # equal scores: runs join from the left, up to the longest run that is a piece
    runs = [v.runs[most]] * (n // most) + ([v.runs[n % most]] if n % most else [])
    return np.append(np.array(runs, "<i4"), ids).astype("<i4").tobytes()


def portions(words: list[str]) -> Iterator[list[str]]:
    """The words in groups of about PORTION characters, which bounds an index."""
    held: list[str] = []
    size = 0
    for w in words:
        if held and size + len(w) > PORTION:
            yield held
            held, size = [], 0
        held.append(w)
        size += len(w) + 1
    if held:
        yield held


def encode_units(v: Vocabulary, units: list[str]) -> list[bytes]:
    """Ids of distinct units, spaces visible."""
    gaps = {u for u in units if u.startswith(SPACE * 2) or u == SPACE}
    words = [u for u in units if u not in gaps]
    words += sorted({SPACE + w for u in gaps if (w := u.lstrip(SPACE))}.difference(words))
    of: dict[str, bytes] = {}
    for part in portions(words):
        of.update(zip(part, encode_words(v, part), strict=True))
    return [spaced(v, u, of) if u in gaps else of[u] for u in units]


def encode_slice(v: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, how many each has), as the model's own encoder gives them; empty texts have none.

    The model puts one space before a text and takes U+2581 for a space. The joined texts are cut wherever no piece holds
    the two characters that meet there; each distinct unit, told by 64 bits of hash, is encoded once and its ids are put
    in every place where it stands.
    """
    whole = [b" " + t.replace(b"\xe2\x96\x81", b" ") if t else b"" for t in texts]
    data = np.frombuffer(b"".join(whole), np.uint8)
    if not len(data):
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    size = np.array([len(w) for w in whole], np.int64)
    first = np.cumsum(size) - size
    cuts = np.ones(len(data), bool)
    cuts[1:] = ~v.joins[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
    cuts[first[size > 0]] = True
    start = np.flatnonzero(cuts)
    del cuts
    end = np.append(start[1:], len(data))
    hashes, at, inverse = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
    place, found = v.look_up(hashes)
    if not found.all():
        if len(v.known) + len(hashes) > REMEMBERED:
            v.forget()
            found[:] = False
        fresh = np.flatnonzero(~found)
        joined = data.tobytes()
        units = [joined[a:b].decode("utf-8", "replace").replace(" ", SPACE) for a, b in zip(start[at[fresh]].tolist(), end[at[fresh]].tolist(), strict=True)]
        ids = dict(zip(distinct := list(dict.fromkeys(units)), encode_units(v, distinct), strict=True))
        v.remember(hashes[fresh], [ids[u] for u in units])
        place, _ = v.look_up(hashes)
    source, n = v.known_at[place][inverse], v.known_n[place][inverse]
    so_far = np.append(0, np.cumsum(n))
    flat = v.pool[np.repeat(source - so_far[:-1], n) + np.arange(so_far[-1])]
    return flat, np.diff(so_far[np.searchsorted(start, np.append(first, len(data)))])


def encode_batch(v: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    flat, n = encode_slice(v, [t.encode("utf-8", "replace") for t in texts])
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def decode_flat(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of ids in a row, the space before each text included."""
    n = v.raw_len[ids]
    so_far = np.append(0, np.cumsum(n))
    return v.raw[np.repeat(v.raw_at[ids] - so_far[:-1], n) + np.arange(so_far[-1])]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids: bytes of unknown characters are joined, one leading space is the model's own."""
    return decode_flat(v, np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace").removeprefix(" ")


def decodes_to(v: Vocabulary, flat: np.ndarray, n: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether each text's ids give back its bytes."""
    back = decode_flat(v, flat)
    ends = np.append(0, np.cumsum(v.raw_len[flat]))[np.append(0, np.cumsum(n))]
    wanted = [b" " + t if t else b"" for t in texts]
    same = np.diff(ends) == np.array([len(w) for w in wanted], np.int64)
    if same.all():
        wrong = np.flatnonzero(back != np.frombuffer(b"".join(wanted), np.uint8))
        same[np.searchsorted(ends, wrong, side="right") - 1] = False
        return same
    return same & np.array([back[a:b].tobytes() == w for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), wanted, strict=True)], bool)


ENCODED = "token_ids array<int>, n_tokens long, round_trip boolean"


def encode_column(model: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(model)
        for texts in batches:
            values, counts, same = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, bool)]
            for _, held in slices(utf8_of(texts), TAKEN):
                flat, n = encode_slice(v, held)
                values.append(flat)
                counts.append(n)
                same.append(decodes_to(v, flat, n, held))
            n = np.concatenate(counts)
            ends = np.append(0, np.cumsum(n)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), pa.int32()))
            values.clear()
            yield pa.StructArray.from_arrays([lists, pa.array(n, pa.int64()), pa.array(np.concatenate(same), pa.bool_())], ["token_ids", "n_tokens", "round_trip"])
            give_back()

    return F.arrow_udf(run, ENCODED)


def decode_column(model: str):
    """Column function: the text of token ids; null ids have none."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(model)
        for ids in batches:
            yield pa.array([None if i is None else decode_ids(v, i) for i in ids.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def encode_documents(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """docs with token_ids, n_tokens and round_trip (do the ids decode to the text?); null and empty texts have no ids.

    round_trip is false only for texts that hold U+2581, which the model cannot tell from a space. Columns of these
    names are replaced; all rows and all other columns stay, whatever their names.
    """
    kept = [F.col(quoted(c)) for c in docs.columns if c not in ("token_ids", "n_tokens", "round_trip")]
    row = docs.select(F.struct(*kept).alias("row"), encode_column(model)(F.col(text_col)).alias("e"))
    return row.select("row.*", "e.*")


def pieces_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, round_trip, token_ids) of every row, repeated rows included. Null and empty texts have no tokens."""
    return encode_documents(docs.select("doc_id", "text"), model=model).select("doc_id", "n_tokens", "round_trip", "token_ids")
