"""Operator 9, SentencePiece encoding and decoding: forward filtering, backward sampling over the piece lattice.

The lattice of a text has an edge for every vocabulary piece that matches at a place, weighted by the piece's rank
(log weight ``-ALPHA * log(rank + RANK_SHIFT)``), and byte pieces for characters of no piece. Forward sums and backward draws
give a segmentation with probability in proportion to the product of its weights. As no piece has a space after another
character, the lattice of a text is a chain of the lattices of its words (a run of spaces and what follows); each distinct
word of a batch is filtered once, and all its occurrences are drawn together. Draws are a hash of the row's key, the seed,
the word's number and the step: they don't depend on batches or partitions.

Decoding is lossless: no normalization; a space is U+2581 in pieces, a U+2581 of the text goes by byte pieces, and the one
space put before a text is taken off again.

Defined cases: null or empty text has no pieces and decodes to an empty text. A null key draws by the text's hash. Rows
of equal key and text get equal pieces. Extra columns are kept out unless named. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shingles import mix
from folioscope.llm.storage import bound_batches

MODEL, ALPHA, RANK_SHIFT, BYTE_LOG = "piece_bpe_32k.model", 1.0, 3.0, -25.0
#: Characters whose words are filtered together, at most; bounds the memory of a batch.
BATCH_CHARS = 2_500_000
SPACE = "▁"
_SPLIT = re.compile(" +[^ ]*|[^ ]+")
_U = np.uint64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


_BASE = 0x9E3779B97F4A7C15


def _slot(h: np.ndarray) -> np.ndarray:
    """Place in a table of 65536 flags, which tells most strings of no piece without a search."""
    return (h * _U(0xD6E8FEB86659FD93) >> _U(48)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


class Vocabulary:
    """Pieces by length as sorted hashes, with ids and log weights; byte pieces; the text of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.zeros(256, dtype=np.int64)
        self.text: list[str] = []
        pieces: dict[int, list[tuple[int, int, float]]] = {}
        rank = 0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte[value] = i
                self.text.append(chr(value) if value < 128 else chr(0xDC00 + value))
            elif model.is_control(i) or model.is_unknown(i) or SPACE in piece.lstrip(SPACE):
                self.text.append("")
            else:
                rank += 1
                own = piece.replace(SPACE, " ")
                h = 0
                for c in own:
                    h = (h * _BASE + ord(c) + 1) % 2**64
                pieces.setdefault(len(own), []).append((h, i, -ALPHA * float(np.log(rank + RANK_SHIFT))))
                self.text.append(own)
        self.by_length = {}
        for n, found in sorted(pieces.items()):
            found.sort()
            hashes = np.array([h for h, _, _ in found], dtype=np.uint64)
            present = np.zeros(1 << 16, dtype=bool)
            present[_slot(hashes)] = True
            self.by_length[n] = (hashes, np.array([i for _, i, _ in found]), np.array([w for _, _, w in found]), present)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _utf8_size(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


class Lattices:
    """Forward-filtered lattices of distinct words in flat arrays. A word of n characters has n + 1 nodes; ``edge_id`` is a
    piece's id, or -1 - code point for a character of no piece. ``upto`` cumulates the shares of the edges into a node."""

    def __init__(self, words: list[str], known: Vocabulary):
        codes = _codes("".join(words))
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), self.length)
        begin = np.cumsum(self.length) - self.length
        place = np.arange(len(codes)) - begin[word]
        self.offset = begin + np.arange(len(words))
        single = np.zeros(len(codes), dtype=bool)
        starts, sizes, ids, logs = [], [], [], []
        shifted = codes + _U(1)
        left = self.length[word] - place  # characters from here to the word's end
        at, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, max(known.by_length) + 1):
            if n > 1:
                more = left[at] >= n
                at, h = at[more], h[more]
            h = h * _U(_BASE) + shifted[at + (n - 1)]
            if n not in known.by_length:
                continue
            hashes, piece, weight, present = known.by_length[n]
            maybe = np.flatnonzero(present[_slot(h)])
            k = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            hit = hashes[k] == h[maybe]
            found, k = at[maybe[hit]], k[hit]
            if n == 1:
                single[found] = True
            starts.append(found)
            sizes.append(np.full(len(found), n))
            ids.append(piece[k])
            logs.append(weight[k])
        rest = np.flatnonzero(~single)
        starts.append(rest)
        sizes.append(np.ones(len(rest), dtype=np.int64))
        ids.append(-1 - codes[rest].astype(np.int64))
        logs.append(BYTE_LOG * _utf8_size(codes[rest].astype(np.int64)))
        start, size, edge_id, log = map(np.concatenate, (starts, sizes, ids, logs))
        end_place = place[start] + size if len(start) else start
        tail = start + word[start]
        head = tail + size
        order = np.argsort(end_place * (len(codes) + len(words) + 1) + head, kind="stable")
        self.start, head, self.edge_id, log, end_place = tail[order], head[order], edge_id[order], log[order], end_place[order]
        del order, tail, edge_id
        cut = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else head
        many = np.diff(np.concatenate([cut, [len(head)]])) if len(head) else head
        forward, share = np.zeros(len(codes) + len(words)), np.zeros(len(head))
        self.first, self.last = np.zeros((2, len(codes) + len(words)), dtype=np.int64)
        self.first[head[cut]], self.last[head[cut]] = cut, cut + many
        # ends by their place in the word: whatever an end's edges start from is done before
        level = np.searchsorted(end_place[cut], np.arange(1, int(self.length.max(initial=0)) + 2))
        for lo, hi in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            begin_, stop = int(cut[lo]), int(cut[hi - 1] + many[hi - 1])
            reach = forward[self.start[begin_:stop]] + log[begin_:stop]
            top = np.maximum.reduceat(reach, cut[lo:hi] - begin_)
            weight = np.exp(reach - np.repeat(top, many[lo:hi]))
            total = np.add.reduceat(weight, cut[lo:hi] - begin_)
            forward[head[cut[lo:hi]]] = top + np.log(total)
            share[begin_:stop] = weight / np.repeat(total, many[lo:hi])
        summed = np.cumsum(share)
        self.upto = summed - np.repeat(summed[cut] - share[cut], many) if len(head) else share

    def draw(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, edge) in text order, for occurrences of ``word`` with a 64-bit ``seed`` each."""
        base = self.offset[word]
        node, live, step, found = base + self.length[word], np.arange(len(word)), 0, []
        while len(live):
            at = node[live]
            lo, hi = self.first[at], self.last[at]
            u = (mix(seed[live] + _U((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> _U(11)).astype(np.float64) / (1 << 53)
            edge = lo.copy()
            more = np.flatnonzero((edge < hi - 1) & (self.upto[edge] <= u))
            while len(more):
                edge[more] += 1
                more = more[(edge[more] < hi[more] - 1) & (self.upto[edge[more]] <= u[more])]
            found.append((live, edge))
            node[live] = self.start[edge]
            live = live[node[live] > base[live]]
            step += 1
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        who, edges = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        when = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
        order = np.lexsort((-when, who))
        return who[order], edges[order]


def row_seed(key: int | str | None, text: str, seed: int) -> int:
    """Seed of a row by its key, a number or a string; by its text without a key."""
    own = "t" + text if key is None or key != key else "s" + key if isinstance(key, str) else f"k{int(key)}"
    return xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass"), seed)


def encode_batch(keys: list, texts: list[str | None], known: Vocabulary, seed: int) -> list[np.ndarray]:
    number: dict[str, int] = {}
    words, owner, seeds = [], [], []
    for i, (key, text) in enumerate(zip(keys, texts, strict=True)):
        if not text:
            continue
        found = _SPLIT.findall(" " + text)
        words += [number.setdefault(w, len(number)) for w in found]
        owner.append((i, len(found)))
        seeds.append(mix(_U(row_seed(key, text, seed)) + np.arange(1, len(found) + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)))
    out = [np.zeros(0, dtype="<u4") for _ in texts]
    if not words:
        return out
    lattices = Lattices(list(number), known)
    who, edges = lattices.draw(np.array(words), np.concatenate(seeds))
    piece = lattices.edge_id[edges]
    long = np.where(piece >= 0, 1, _utf8_size(-1 - piece))
    starts = np.cumsum(long) - long
    ids = np.zeros(int(long.sum()), dtype="<u4")
    ids[starts[piece >= 0]] = piece[piece >= 0]
    for code in np.unique(piece[piece < 0]).tolist():
        at = starts[piece == code]
        for k, b in enumerate(chr(-1 - code).encode("utf-8", "surrogatepass")):
            ids[at + k] = known.byte[b]
    rows = np.repeat([i for i, _ in owner], [n for _, n in owner])
    per_row = np.bincount(rows[who], weights=long, minlength=len(texts)).astype(np.int64)
    cuts = np.cumsum(per_row)
    for i, _ in owner:
        out[i] = ids[cuts[i] - per_row[i] : cuts[i]]
    return out


def decode(ids: np.ndarray, known: Vocabulary) -> str:
    text = "".join(map(known.text.__getitem__, ids.tolist())).encode("utf-8", "surrogateescape").decode("utf-8", "surrogatepass")
    return text[1:]


def _slices(texts: pd.Series) -> Iterator[slice]:
    """Rows of ``BATCH_CHARS`` characters at most, or one longer row."""
    upto = texts.str.len().fillna(0).cumsum().to_numpy()
    at = 0
    while at < len(upto):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_CHARS, side="right")))
        yield slice(at, stop)
        at = stop


def _encode(path: str, seed: int, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary(path)
        for batch in batches:
            for part in map(batch.iloc.__getitem__, _slices(batch["text"].astype(object))):
                ids = encode_batch(part["_key"].tolist(), part["text"].tolist(), known, seed)
                back = [decode(x, known) == (t or "") for x, t in zip(ids, part["text"], strict=True)]
                yield part[keep].assign(ids=[x.tobytes() for x in ids], n_pieces=[len(x) for x in ids], lossless=back)

    return run


def _decode(path: str, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary(path)
        for batch in batches:
            yield batch[keep].assign(text=pd.Series([decode(np.frombuffer(b or b"", "<u4"), known) for b in batch["ids"]], index=batch.index, dtype=object))

    return run


def _schema(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)


def encode_documents(docs: DataFrame, key: str = "doc_id", seed: int = 17, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The ``keep`` columns, ids (binary, little-endian unsigned 32-bit), n_pieces and lossless (decoding gives the text back)."""
    rows = docs.select(*keep, F.col(key).alias("_key"), "text")
    return rows.mapInPandas(_encode(path or default_path(), seed, list(keep)), _schema(docs, keep) + ", ids binary, n_pieces long, lossless boolean")


def decode_documents(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The ``keep`` columns and the text of ``ids``."""
    bound_batches(encoded.sparkSession)
    return encoded.select(*keep, "ids").mapInPandas(_decode(path or default_path(), list(keep)), _schema(encoded, keep) + ", text string")
