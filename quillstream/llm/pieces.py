"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The marked words of a batch (a run of word marks and what follows, which no piece crosses) are made distinct and
sorted, which is a depth-first walk of their trie: a word starts from the forward states of the prefix it shares with
the word before, and only the rest is computed. A forward state of a prefix holds its best score, last piece and back
pointer.

For a unigram model the best path is the one with the greatest sum of scores. For a BPE model, as the public 32k file
is, a sum of scores is not what the reference tokenizer minimises: there a path is right exactly if each two neighbours
are what BPE makes of their joined text. Every prefix has one such path, so the forward states hold that one, and
prefixes are shared in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillstream.llm import common

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words that a worker remembers; beyond it the memory starts anew. It changes speed, never results.
REMEMBER = 400_000
PIECE_BYTES = 1 << 20


def message(raw: bytes) -> list[tuple[int, int | bytes]]:
    """Fields of a message in the protocol-buffer wire format, as (number, value)."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return value

    while i < len(raw):
        tag = varint()
        if tag & 7 == 0:
            out.append((tag >> 3, varint()))
        else:
            n = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            out.append((tag >> 3, raw[i : i + n]))
            i += n
    return out


class PieceModel:
    """Vocabulary and forward pass. Small and picklable: it is broadcast, its size that of the vocabulary."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], unknown: int, special: set[int], kind: str = "unigram", prefix: bool = True):
        self.pieces, self.byte_ids, self.unknown, self.special, self.scores = pieces, byte_ids, unknown, special, scores
        self.id_of = {p: i for i, p in enumerate(pieces) if i not in special}
        self.score = {p: scores[i] for p, i in self.id_of.items()}
        self.kind, self.prefix = kind, prefix
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self._clear()

    def _clear(self) -> None:
        self._nodes: tuple | None = None
        self._pair: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._memo: dict[bytes, int] = {}
        self._table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._bytes = None

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> PieceModel:
        """A model file as its trainer wrote it. What this encoder doesn't follow is refused, not encoded wrongly: kinds but
        BPE and unigram, character maps of the normaliser, the removal of white space, marks behind words, user pieces."""
        import sentencepiece

        raw = Path(path).read_bytes()
        m = sentencepiece.SentencePieceProcessor(model_proto=raw)
        trainer, normaliser = ({k: v for k, v in message(next((v for k, v in message(raw) if k == part), b""))} for part in (2, 3))
        kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
        user = [v for k, v in message(raw) if k == 1 and dict(message(v)).get(3) == 4]
        if kind is None or normaliser.get(2) or normaliser.get(4, 1) or trainer.get(24) or not normaliser.get(5, 1) or user:
            raise ValueError(f"{path}: a kind of model, normaliser or piece that is not supported")
        n = m.vocab_size()
        special = {i for i in range(n) if m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i)}
        pieces = [m.id_to_piece(i) for i in range(n)]
        by_name = {pieces[i]: i for i in range(n) if m.is_byte(i)}
        byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)] if by_name else []
        return cls(pieces, [m.get_score(i) for i in range(n)], byte_ids, m.unk_id(), special, kind, bool(normaliser.get(3, 1)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._clear()

    # --- BPE admissibility -----------------------------------------------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition: the best-scored neighbouring pair first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        """Tokens from the vocabulary's size on are single characters that it lacks."""
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def alone(self, token: int) -> bool:
        """Whether BPE makes the token of its own text."""
        ok = self._alone.get(token)
        if ok is None:
            ok = self._alone[token] = len(self.merged(self._text(token))) == 1
        return ok

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE makes these two tokens of their joined text."""
        x, y = self._text(left), self._text(right)
        if len(self._pair) > 8 * REMEMBER:
            self._pair.clear()
        ok = self._pair[left << 22 | right] = self.merged(x + y) == [x, y]
        return ok

    # --- forward pass over the trie --------------------------------------------------------------------------------
    def _automaton(self) -> tuple[list[dict[str, int]], list[int], list[list[tuple[int, int]]]]:
        """For each state: its steps, the state of the longest proper suffix, and the pieces that end there as
        (length, id), longest first. A state is reached by the longest suffix that starts a piece."""
        steps: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, int]]] = [[]]
        back = [0]
        for piece, i in self.id_of.items():
            at = 0
            for c in piece:
                to = steps[at].get(c)
                if to is None:
                    to = steps[at][c] = len(steps)
                    steps.append({})
                    ends.append([])
                    back.append(0)
                at = to
            ends[at].insert(0, (len(piece), i))
        queue = list(steps[0].values())
        for at in queue:  # grows while it is walked: breadth first
            for c, to in steps[at].items():
                f = back[at]
                while f and c not in steps[f]:
                    f = back[f]
                back[to] = steps[f].get(c, 0)
                queue.append(to)
            ends[at] = ends[at] + ends[back[at]]
        return steps, back, ends

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted distinct marked words."""
        if self._nodes is None:
            self._nodes = self._automaton()
        steps, back, ends = self._nodes
        first, pair, v, bpe = steps[0], self._pair, len(self.pieces), self.kind == "bpe"
        # of each prefix on the current path of the words' trie: automaton state, last token, its length, score
        state, last, size, total = [0], [-1], [0], [0.0]
        before, out = "", []
        for w in words:
            shared, most = 0, min(len(w), len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del state[shared + 1 :], last[shared + 1 :], size[shared + 1 :], total[shared + 1 :]
            at = state[shared]
            for end in range(shared + 1, len(w) + 1):
                c = w[end - 1]
                while True:
                    to = steps[at].get(c)
                    if to is not None:
                        at = to
                        break
                    if not at:
                        break
                    at = back[at]
                token, length, best = v + ord(c), 1, None
                if bpe:
                    for n, i in ends[at]:
                        start = end - n
                        if start:
                            ok = pair.get(last[start] << 22 | i)
                            if ok is None:
                                ok = self.fits(last[start], i)
                        else:
                            ok = self.alone(i)
                        if ok:
                            token, length, best = i, n, total[start] + self.scores[i]
                            break
                else:
                    for n, i in ends[at]:
                        s = total[end - n] + self.scores[i]
                        if best is None or s > best:
                            token, length, best = i, n, s
                    if c not in first or not ends[at] or ends[at][-1][0] > 1:  # the character alone is no piece
                        s = total[end - 1] + self.unknown_score
                        if best is None or s > best:
                            token, length, best = v + ord(c), 1, s
                state.append(at)
                last.append(token)
                size.append(length)
                total.append(total[end - 1] + self.unknown_score if best is None else best)
            ids, end = [], len(w)
            while end:
                ids.append(last[end])
                end -= size[end]
            ids.reverse()
            out.append(ids if max(ids, default=0) < v else [i for t in ids for i in ([t] if t < v else self.ids_of(chr(t - v)))])
            before = w
        return out

    def ids_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    # --- batches ---------------------------------------------------------------------------------------------------
    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Index of each distinct word in the flat table of ids."""
        memo = self._memo
        if len(memo) > REMEMBER:
            memo.clear()
            self._table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        new = sorted(w.decode().replace(" ", MARK) for w in words if w not in memo)
        if new:
            starts, lens, flat = self._table
            got = self.encode_words(new)
            for k, w in enumerate(new, len(starts)):
                memo[w.replace(MARK, " ").encode()] = k
            n = np.array([len(x) for x in got], np.int64)
            self._table = np.concatenate([starts, len(flat) + np.cumsum(n) - n]), np.concatenate([lens, n]), np.concatenate([flat, np.array([i for x in got for i in x], np.int32)])
        return np.array([memo[w] for w in words], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets by text. A null or empty text has no ids."""
        t = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        some = pc.and_(pc.greater(pc.binary_length(t), 0), self.prefix)
        t = pc.if_else(some, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), t, pa.scalar(" ", pa.large_string())), t)
        data, offsets = common.utf8(t)
        flat, counts = [np.zeros(0, np.int32)], np.zeros(len(t), np.int64)
        i = 0
        while i < len(t):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(d):
                space = d == 0x20
                first = space.copy()
                first[1:] &= ~space[:-1]
                first[o[:-1][np.diff(o) > 0]] = True
                start = np.flatnonzero(first)
                end = np.append(start[1:], len(d))
                h = common.word_hashes(d, start, end)
                _, at, which = np.unique(h, return_index=True, return_inverse=True)
                raw = d.tobytes()
                index = self._learn([raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])[which]
                starts, lens, table = self._table
                n = lens[index]
                ends = np.cumsum(n)
                flat.append(table[np.repeat(starts[index] - ends + n, n) + np.arange(ends[-1])])
                sums = np.concatenate([[0], ends])
                w = np.searchsorted(start, o)
                counts[i:j] = sums[w[1:]] - sums[w[:-1]]
            i = j
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(counts)])

    def bytes_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        raw = [byte_of.get(i, b" \xe2\x81\x87 " if i == self.unknown else b"" if i in self.special else p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        lens = np.array([len(x) for x in raw], np.int64)
        return np.concatenate([[0], np.cumsum(lens)])[:-1], lens, np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: the pieces' bytes joined, marks as spaces, the leading mark dropped."""
        if self._bytes is None:
            self._bytes = self.bytes_table()
        starts, lens, table = self._bytes
        out: list[bytes] = []
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES // 4, "right")) - 1)
            x = ids[offsets[i] : offsets[j]]
            n = lens[x]
            ends = np.cumsum(n)
            raw = table[np.repeat(starts[x] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            at = np.concatenate([[0], ends])[offsets[i : j + 1] - offsets[i]].tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                s = raw[a:b]
                out.append(s[1:] if self.prefix and s[:1] == b" " else s)
            i = j
        return out


def encode_pieces(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """docs without its text, with n_tokens long, ids array<int> and round_trip boolean (decoding gives the text back).

    ``round_trip`` compares with the text after marks (U+2581) became spaces, which is all the model can't tell apart. A
    null or empty text has no ids and a true round trip; very long texts and words are taken whole; each row is encoded
    alone, so repeated rows and ids are as many results; of equal sums the longest last piece wins; an empty table gives
    no rows; columns named n_tokens, ids or round_trip are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_tokens", "ids", "round_trip", text)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            t = batch.column(len(keep))
            ids, offsets = m.encode(t)
            plain = pc.replace_substring(t.cast(pa.large_string()).fill_null(""), MARK, " ")
            same = pc.equal(pa.array(m.decode(ids, offsets), pa.large_binary()), plain.cast(pa.large_binary()))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(offsets)), lists, same], names=[*keep, "n_tokens", "ids", "round_trip"])

    d = docs.select(*keep, text)
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("round_trip", "boolean")
    return d.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, model: PieceModel, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text that each row's ids spell in place of the ids.

    Bytes that are no UTF-8 become U+FFFD; null and empty ids give an empty text, null ids in a list are left out, ids
    outside the vocabulary raise. A column named like the text is replaced; an empty table gives no rows.
    """
    keep = [c for c in df.columns if c not in (ids, text)]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(shared.value.pieces)):
                raise ValueError("an id outside the vocabulary")
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            out = [x.decode("utf-8", "replace") for x in shared.value.decode(flat, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, text])

    some = F.coalesce(F.filter(F.col(ids).cast("array<int>"), lambda x: x.isNotNull()), F.array().cast("array<int>")).alias(ids)
    return df.select(*keep, some).mapInArrow(run, df.select(*keep).schema.add(text, "string"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return encode_pieces(common.table(spark, sf_dir, "documents").select("doc_id", "text"), PieceModel.load())
