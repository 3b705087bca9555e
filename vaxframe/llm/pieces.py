"""Encoding texts to pieces by unigram Viterbi over a double-array trie, and decoding them exactly.

The piece list of a public vocabulary file is read once on the driver; nothing is trained. Its scores are
merge ranks, which are no probabilities, so a piece's log score is that of Zipf's law at its rank (single
characters, listed last, take the lowest rank). A character that no piece spells becomes the bytes of its
UTF-8 form, at BYTE_SCORE each. Spaces become the marker U+2581, one marker goes before the text, and a
marker that the text itself holds is spelled in bytes, so decoding gives back every text exactly.

No piece holds a marker after another character, so the best path of a text is the best paths of its parts
between markers, and each distinct part of a chunk is solved once: short ones together, character by
character, long ones alone. Work grows with the text's length, memory with the chunk.

Defined results: null and empty texts have no pieces and decode to "". Equal paths: the piece that begins
first wins, then the longer of two from one place. Columns other than doc_id and text are unused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vaxframe.llm import words as w

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
BYTE_SCORE = -14.0
#: Parts up to so many characters are solved side by side.
SIDE_BY_SIDE = 48
#: Parts whose ids a worker keeps between chunks (about 250 bytes each).
REMEMBERED = 200_000
#: Texts solved at a time; a chunk takes about 60 times its bytes.
PIECE_BYTES = 1 << 20
#: Stands for a marker that the text itself holds; above all code points.
OWN_MARK = 0x110000


def read_pieces(path: str = MODEL) -> list[tuple[str, int]]:
    """(spelling, id) of all pieces, and of the 256 byte pieces as (\"\", id) in byte order at the front."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    spelled = [(model.id_to_piece(i), i) for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    as_bytes = sorted((model.id_to_piece(i), i) for i in range(size) if model.is_byte(i))
    return [("", i) for _, i in as_bytes] + spelled


class DoubleArray:
    """A trie over dense character codes in two arrays: the child of node s by code c is base[s] + c, if check there is s."""

    def __init__(self, keys: list[tuple[tuple[int, ...], int]], n_codes: int):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for codes, v in keys:
            at = 0
            for c in codes:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][c]
            value[at] = v
        size = 4 * len(children) + 4 * n_codes + 8192
        base, check, self_value = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        used = np.zeros(size, bool)
        used[: n_codes + 1], place, free = True, {0: 0}, n_codes + 1  # room below, so that a base is never negative
        self_value[0] = value[0]
        for node in range(len(children)):  # parents come before children
            kids = np.array(sorted(children[node]), np.int64)
            if not len(kids):
                base[place[node]] = 0
                continue
            while used[free]:
                free += 1
            low, at = free, -1
            while at < 0:  # the first place with room for all children, a stretch at a time
                places = np.flatnonzero(~used[low : low + 4096]) + low - kids[0]
                fits = ~used[places[:, None] + kids].any(1)
                at = int(places[fits.argmax()]) if fits.any() else -1
                low += 4096
            s = place[node]
            base[s] = at
            used[at + kids] = True
            check[at + kids] = s
            for c in kids.tolist():
                child = children[node][c]
                place[child] = at + c
                self_value[at + c] = value[child]
        top = int(np.flatnonzero(used).max()) + n_codes + 2
        self.base, self.check, self.value = base[:top], check[:top], self_value[:top]


class Pieces:
    """Encoder and decoder of one piece list."""

    def __init__(self, pieces: list[tuple[str, int]]):
        self.byte_ids = np.array([i for p, i in pieces if not p], np.int64)
        spelled = [(p, i) for p, i in pieces if p]
        if len(self.byte_ids) != 256 or any(a != MARK and b == MARK for p, _ in spelled for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece list needs 256 bytes and no marker after another character")
        alphabet = sorted({c for p, _ in spelled for c in p})
        self.memory: dict[str, bytes] = {}
        self.code_of = np.zeros(OWN_MARK + 1, np.int32)  # 0: no piece has the character
        self.code_of[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.score = np.array([-np.log(1.0 + k) - 2.0 for k in range(len(spelled))])
        self.ids = np.array([i for _, i in spelled], np.int64)
        self.longest = max(len(p) for p, _ in spelled)
        self.trie = DoubleArray([(tuple(int(self.code_of[ord(c)]) for c in p), k) for k, (p, _) in enumerate(spelled)], len(alphabet) + 1)
        top = max(i for _, i in pieces) + 1
        spell = [b""] * top
        for p, i in spelled:
            spell[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            spell[i] = bytes([b])
        self.spelling = np.frombuffer(b"".join(spell), np.uint8)
        self.spell_len = np.array([len(x) for x in spell], np.int64)
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len

    # -- paths: for each character the start of the best last piece that ends there, -1 - start for bytes

    def side_by_side(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of parts of one length; chars is (parts, length) code points. Returns (from, piece) for each end."""
        n, length = chars.shape
        codes = self.code_of[chars]
        width = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        trie = self.trie
        for i in range(length):
            by_bytes = best[:, i] + BYTE_SCORE * width[:, i]
            better = by_bytes > best[:, i + 1]
            best[better, i + 1], came[better, i + 1], piece[better, i + 1] = by_bytes[better], i, -1
            rows, node = np.arange(n), np.zeros(n, np.int64)
            for j in range(i, min(length, i + self.longest)):
                code = codes[rows, j]
                nxt = trie.base[node] + code
                alive = (code > 0) & (trie.check[nxt] == node) & (nxt > 0)
                rows, node = rows[alive], nxt[alive]
                if not len(rows):
                    break
                k = trie.value[node]
                ends = k >= 0
                r, kk = rows[ends], k[ends]
                total = best[r, i] + self.score[kk]
                better = total > best[r, j + 1]
                r, kk = r[better], kk[better]
                best[r, j + 1], came[r, j + 1], piece[r, j + 1] = total[better], i, kk
        return came, piece

    def alone(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one part of any length."""
        length = len(chars)
        codes = self.code_of[chars].tolist()
        width = (1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)).tolist()
        base, check, value, score = (x for x in (self.trie.base, self.trie.check, self.trie.value, self.score))
        best = [float("-inf")] * (length + 1)
        best[0] = 0.0
        came, piece = [0] * (length + 1), [-1] * (length + 1)
        for i in range(length):
            total = best[i] + BYTE_SCORE * width[i]
            if total > best[i + 1]:
                best[i + 1], came[i + 1], piece[i + 1] = total, i, -1
            node = 0
            for j in range(i, min(length, i + self.longest)):
                nxt = int(base[node]) + codes[j]
                if not codes[j] or check[nxt] != node:
                    break
                node = nxt
                k = int(value[node])
                if k >= 0:
                    total = best[i] + float(score[k])
                    if total > best[j + 1]:
                        best[j + 1], came[j + 1], piece[j + 1] = total, i, k
        return np.array([came], np.int32), np.array([piece], np.int32)

    def _ids(self, chars: np.ndarray, came: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walk the paths back; all ids, part after part, and the number of each part."""
        n, length = chars.shape
        at, rows, steps = np.full(n, length), np.arange(n), []
        while len(rows):
            end = at[rows]
            k = piece[rows, end]
            steps.append((rows, np.where(k >= 0, self.ids[k], -1 - chars[rows, end - 1])))
            at[rows] = came[rows, end]
            rows = rows[at[rows] > 0]
        rows = np.concatenate([r for r, _ in steps])
        found = np.concatenate([x for _, x in steps])
        order = np.lexsort((-np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps]), rows))
        rows, found = rows[order], found[order]
        odd = np.flatnonzero(found < 0)
        if len(odd):  # characters that no piece spells, as the ids of their bytes
            spelled = [self.byte_ids[list((MARK if c == OWN_MARK else chr(c)).encode())] for c in (-1 - found[odd]).tolist()]
            sizes = np.ones(len(found), np.int64)
            sizes[odd] = [len(x) for x in spelled]
            starts = np.cumsum(sizes) - sizes
            out = np.repeat(found, sizes)
            out[w.ragged(starts[odd], sizes[odd])] = np.concatenate(spelled)
            rows, found = np.repeat(rows, sizes), out
        return found, np.bincount(rows, minlength=n)

    def parts(self, distinct: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of each part. Solved parts are remembered, up to REMEMBERED of them."""
        memory = self.memory
        new = [x for x in distinct if x not in memory]
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = distinct
        lengths = np.array([len(x) for x in new], np.int64)
        for length in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == length).tolist()
            coded = "".join([new[i] for i in which]).encode("utf-32-le", "surrogatepass")
            chars = np.frombuffer(coded, np.uint32).reshape(-1, length).astype(np.int64)
            if length <= SIDE_BY_SIDE:
                ids, sizes = self._ids(chars, *self.side_by_side(chars))
            else:
                solved = [self._ids(row[None], *self.alone(row)) for row in chars]
                ids, sizes = np.concatenate([x for x, _ in solved]), np.concatenate([n for _, n in solved])
            data, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            begin = 0
            for i, end in zip(which, ends, strict=True):
                memory[new[i]] = data[begin:end]
                begin = end
        return [memory[x] for x in distinct]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and where each text's begin."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        plain = texts if not special.any() else pc.if_else(pa.array(special), "", texts)
        lists = pc.split_pattern(plain, " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        last = np.zeros(len(flat), bool)
        last[offsets[1:] - 1] = True
        filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(filled | last)  # entries that end a part; empty ones before them are more markers
        before = np.diff(ends, prepend=-1) - 1
        empty = pc.equal(plain, "").to_numpy(zero_copy_only=False)
        kept = ~np.isin(ends, offsets[1:][empty] - 1)
        ends, before = ends[kept], before[kept]
        coded = flat.take(pa.array(ends)).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        distinct = [MARK + x for x in coded.dictionary.to_pylist()]
        wide = np.flatnonzero(before)
        if len(wide):
            extra = [MARK * int(before[i]) + distinct[codes[i]] for i in wide]
            codes[wide] = len(distinct) + np.arange(len(wide))
            distinct += extra
        solved = self.parts(distinct)
        sizes = np.array([len(x) for x in solved], np.int64) // 4
        every = np.frombuffer(b"".join(solved), "<i4")
        ids = every[w.ragged((np.cumsum(sizes) - sizes)[codes], sizes[codes])] if len(codes) else np.empty(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(sizes[codes])])[np.searchsorted(ends, offsets)]
        return self._insert_marked(ids, bounds, texts, np.flatnonzero(special)) if special.any() else (ids, bounds)

    def _insert_marked(self, ids: np.ndarray, bounds: np.ndarray, texts: pa.Array, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold the marker themselves are each solved as one part."""
        lists = np.split(ids, bounds[1:-1])
        for i in which.tolist():
            text = texts[i].as_py()
            chars = np.array([ord(MARK)] + [ord(MARK) if c == " " else OWN_MARK if c == MARK else ord(c) for c in text], np.int64)
            lists[i] = self._ids(chars[None], *self.alone(chars))[0].astype(np.int32)
        return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts, as UTF-8, without the marker that encoding put before each."""
        sizes = self.spell_len[ids]
        data = self.spelling[w.ragged(self.spell_at[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _piece_rows(shared, keep_ids: bool):
    def run(batches):
        coder: Pieces = shared.value
        for batch in w.chunks(batches, max_bytes=PIECE_BYTES):
            texts = batch.column("text")
            ids, bounds = coder.encode(texts)
            plain = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
            back = coder.decode(ids, bounds)
            fallback = np.concatenate([[0], np.cumsum(np.isin(ids, coder.byte_ids))])[bounds]
            narrow = ids.astype(np.int32)
            columns = {
                "doc_id": batch.column("doc_id"), "n_pieces": pa.array(np.diff(bounds), pa.int64()), "n_bytes": pa.array(np.diff(fallback), pa.int64()),
                "pieces_sha256": pa.array([hashlib.sha256(narrow[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                "round_trip": pa.array([a == b for a, b in zip(back, plain, strict=True)])}
            if keep_ids:
                columns["pieces"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(narrow))
            yield pa.RecordBatch.from_pydict(columns)

    return run


RESULT = "doc_id long, n_pieces long, n_bytes long, pieces_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, model: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """Pieces of every document: ids (int32), counts, digests (ids as little-endian int32) and whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(read_pieces(model)))  # a few MB, fixed by the vocabulary
    return docs.select("doc_id", "text").mapInArrow(_piece_rows(shared, keep_ids), RESULT + (", pieces array<int>" if keep_ids else ""))


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, pieces)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(read_pieces(model)))

    def run(batches):
        for batch in batches:
            lists = pc.fill_null(batch.column("pieces"), [])
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            texts = shared.value.decode(lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([x.decode("utf-8", "replace") for x in texts])})

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
