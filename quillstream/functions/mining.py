"""Counts of runs of words within documents, over Arrow batches.

Made as rows, all runs of 1 to 4 words are some four times the words of a corpus, each a string to hash. Here words are
numbers, and a run is looked at only where both runs that are a word shorter occur often enough: one that occurs ``least``
times has parts that do, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that Python lowers in another way than one by one.
_ALONE = str.maketrans("İΣ", "iσ")
#: Bytes of text looked at together; one document may be more.
_CHUNK = 4 << 20


def lowered(word: str) -> str:
    return word.translate(_ALONE).lower()


def singular(low: str) -> str:
    """A word in lower case with its plural folded."""
    if len(low) > 4 and low.endswith("ies"):
        return low[:-3] + "y"
    return low[:-1] if len(low) > 3 and low.endswith("s") and not low.endswith("ss") else low


def _numbers(strings: list[str]) -> tuple[np.ndarray, list[str]]:
    """The number of each string among the distinct ones, and these."""
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(s, len(seen)) for s in strings], dtype=np.int64), list(seen)


def _dense(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as numbers from 0, and how often each occurs."""
    _, number, times = np.unique(code, return_inverse=True, return_counts=True)
    return number, times


def _best(group: np.ndarray, form: np.ndarray, capital: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group (ascending): the place of an occurrence of its best form, the occurrences of the group, whether all
    forms are capitalised. The best form begins with a small letter, then is the most frequent, then the first by rank."""
    _, at, n = np.unique(group * (int(form.max()) + 1) + form, return_index=True, return_counts=True)
    order = np.lexsort((rank[at], -n, capital[at], group[at]))
    at, n = at[order], n[order]
    first = np.flatnonzero(np.diff(group[at], prepend=-1))
    return at[first], np.add.reduceat(n, first), capital[at[first]]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Row, clause and word of each word, in order, and the distinct words. Words begin with a letter and go on with letters
    and numbers; signs of punctuation end a clause."""
    clauses = pc.split_pattern_regex(texts, r'[\n.,;:!?()|"]+')
    row = pc.list_parent_indices(clauses).to_numpy()
    tokens = pc.split_pattern_regex(pc.list_flatten(clauses), r"[^\p{L}\p{N}]+")
    clause = pc.list_parent_indices(tokens).to_numpy()
    coded = pc.dictionary_encode(pc.list_flatten(tokens))
    token, words = _numbers(pc.replace_substring_regex(coded.dictionary, r"^\p{N}+", "").to_pylist())
    word = token[coded.indices.to_numpy()] if len(token) else np.zeros(0, dtype=np.int64)
    empty = np.array([w == "" for w in words], dtype=bool)
    held = ~empty[word] if len(words) else np.zeros(0, dtype=bool)
    return row[clause[held]], clause[held], word[held], words


def frequent_runs(doc: np.ndarray, texts: pa.Array, stop: frozenset[str], least: tuple[int, int, int], most_words: int = 4) -> list[tuple]:
    """(doc, key, surface, words, cnt, capital) of the runs of a document that occur often enough. doc: a number a text.

    ``least``: occurrences asked of several words, of a capitalised word, of a plain one.
    """
    row, clause, word, words = _words(texts)
    if not len(word):
        return []
    many, least_capital, least_plain = least
    lows = [lowered(w) for w in words]
    acronym = np.asarray(pc.greater_equal(pc.count_substring_regex(pa.array(words, pa.string()), r"\p{Lu}"), 2).to_numpy(zero_copy_only=False), dtype=bool)
    stopped = np.array([w in stop for w in lows], dtype=bool)
    capital = np.array([w[:1] != lowered(w[:1]) for w in words], dtype=bool)
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    low, low_words = _numbers(lows)
    fold, folds = _numbers([singular(w) for w in lows])
    key, keys = _numbers([w if a else singular(x) for w, a, x in zip(words, acronym, lows, strict=True)])
    d = doc[row]
    out: list[tuple] = []

    # single words: acronyms as they are
    at = np.flatnonzero(~stopped[word])
    group, times = _dense(d[at] * len(keys) + key[word[at]])
    often = times[group] >= min(least_capital, least_plain)
    at, group = at[often], group[often]
    if len(at):
        place, cnt, all_capital = _best(group, word[at], capital[word[at]], rank[word[at]])
        place = at[place]
        for i, n, c in zip(place.tolist(), cnt.tolist(), all_capital.tolist(), strict=True):
            if n >= (least_capital if c else least_plain) and len(keys[key[word[i]]]) > 1:
                out.append((int(d[i]), keys[key[word[i]]], words[word[i]], 1, n, c))

    # longer runs from those a word shorter; prefix and form number the runs in lower case and as they are
    alive = np.zeros(len(word) + 1, dtype=bool)
    at = np.flatnonzero(~stopped[word] & ~acronym[word])
    group, times = _dense(d[at] * len(folds) + fold[word[at]])
    alive[at] = times[group] >= many
    prefix, form = d * len(low_words) + low[word], word.copy()
    for k in range(2, most_words + 1):
        at = np.flatnonzero(alive[:-1] & alive[1:])
        at = at[at + k - 1 < len(word)]
        last = at + k - 1
        fits = (clause[at] == clause[last]) & (low[word[at]] != low[word[last]])
        at, last = at[fits], last[fits]
        if not len(at):
            break
        start, _ = _dense(prefix[at])
        group, times = _dense(start * len(folds) + fold[word[last]])
        often = times[group] >= many
        at, last, start, group = at[often], last[often], start[often], group[often]
        alive = np.zeros(len(word) + 1, dtype=bool)
        if not len(at):
            break
        alive[at] = True
        before, _ = _dense(form[at])
        as_is, _ = _dense(before * len(words) + word[last])
        prefix[at], form[at] = _dense(start * len(low_words) + low[word[last]])[0], as_is
        one, where = np.unique(as_is, return_index=True)
        surfaces = [" ".join(words[word[i + j]] for j in range(k)) for i in at[where].tolist()]
        by_text = np.empty(len(one), dtype=np.int64)
        by_text[sorted(range(len(one)), key=surfaces.__getitem__)] = np.arange(len(one))
        place, cnt, all_capital = _best(group, as_is, capital[word[at]], by_text[as_is])
        for p, n, c in zip(place.tolist(), cnt.tolist(), all_capital.tolist(), strict=True):
            i = at[p]
            inner = [low_words[low[word[i + j]]] for j in range(k - 1)]
            out.append((int(d[i]), " ".join([*inner, folds[fold[word[i + k - 1]]]]), surfaces[as_is[p]], k, n, c))
    return out


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts, some bytes at a time, from rows in order of id: rows of one id come together."""
    ids = texts = None
    for b in batches:
        if not len(b):
            continue
        ids = b.column(0) if ids is None else pa.concat_arrays([ids, b.column(0)])
        texts = b.column(1) if texts is None else pa.concat_arrays([texts, b.column(1)])
        code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        begin = 0
        for s in starts[1:].tolist():  # the rows of the last id may go on in the next batch
            if size[s] - size[begin] >= _CHUNK:
                yield ids[begin:s], texts[begin:s]
                begin = s
        ids, texts = ids[begin:], texts[begin:]
    if ids is not None and len(ids):
        yield ids, texts


def runs_of_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, stop: frozenset[str], least: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """(id, key, surface, words, cnt, capital) of rows (id, text) that are in order of id; texts aren't null."""
    for ids, texts in _documents(batches):
        coded = pc.dictionary_encode(ids, null_encoding="encode")
        found = frequent_runs(coded.indices.to_numpy().astype(np.int64), texts, stop, least)
        if found:
            doc, *rest = zip(*found, strict=True)
            columns = [coded.dictionary.take(pa.array(doc, pa.int32())), *(pa.array(c) for c in rest)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
