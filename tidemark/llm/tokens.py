"""Token ids of whole texts: each distinct word of a batch goes through the tokenizers library once.

A batch is split and dictionary-encoded in Arrow; ids are then gathered by offsets in numpy. That
equals encoding whole texts for vocabularies that drop white space, lower the case and mark words'
last tokens with ``</w>``, such as word_bpe_49k. Texts that hold one of the vocabulary's special
tokens go through the library whole, as it is loaded.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FOUND: dict[str, Encoder] = {}
_TOGETHER = 50  # words in a text of their own
_AT_ONCE = 1000  # texts in a call
_OFTEN = 3  # times that a batch holds a word that is remembered
#: Lower-case letters of Latin-1 alone: normalising leaves them as they are, and they are one token's text.
_LETTERS = r"[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+"
_SIMPLE = rf"\A{_LETTERS}\z"
_SIGNED = rf"\A(?P<base>{_LETTERS})(?P<signs>[!-&(-/:-@\[-`{{-~]+)\z"


class Encoder:
    """Ids of words between blanks. Words that a batch holds often are remembered, up to ``bound`` words."""

    def __init__(self, path: str, bound: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.bound = bound
        self.whole, self.words, self.simple = (Tokenizer.from_file(path) for _ in range(3))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words.encode_special_tokens = True  # a word in capitals may be a special token once it is lowered
        for t in (self.whole, self.words, self.simple):
            t.no_truncation()
            t.no_padding()
        self.simple.normalizer = None
        self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.words.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets all words, as at a task's end: a worker lives on, and its next task may be of another kind."""
        self.known: pa.StringArray = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.known) + len(words) > self.bound:
            self.clear()
        if len(words) <= self.bound:
            self.known = pa.concat_arrays([self.known, words])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def _one_by_one(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _called(self.words, _listed(words))

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of simple words, many in a text; those of texts that part wrongly again one by one."""
        n_words = np.minimum(_TOGETHER, len(words) - np.arange(0, len(words), _TOGETHER))
        edges = pa.array(np.insert(np.cumsum(n_words), 0, 0), pa.int32())
        ids, n = _called(self.simple, _listed(pc.binary_join(pa.ListArray.from_arrays(edges, words), " ")))
        ends, last = np.cumsum(n), self.last[ids]
        before = np.insert(np.cumsum(last), 0, 0)
        right = (n > 0) & (before[ends] - before[ends - n] == n_words)
        right[right] = last[ends[right] - 1]
        if right.all():
            return ids, np.diff(np.flatnonzero(last) + 1, prepend=0)
        held, of = np.repeat(right, n), np.repeat(right, n_words)
        again, again_sizes = self._one_by_one(words.filter(pa.array(~of)))
        ids, sizes = ids[held], np.zeros(len(words), np.int64)
        sizes[of], sizes[~of] = np.diff(np.flatnonzero(last[held]) + 1, prepend=0), again_sizes
        starts = np.zeros(len(words), np.int64)
        starts[of], starts[~of] = np.cumsum(sizes[of]) - sizes[of], len(ids) + np.cumsum(again_sizes) - again_sizes
        return np.concatenate([ids, again])[_places(starts, sizes)], sizes

    def learn(self, words: list[str] | pa.Array, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word the place of its first id and their number; words that are ``often`` met (default: all) are kept.

        Simple words are encoded many at once, and parted at the tokens that end a word; a simple word
        and signs without apostrophe after it are two words to the vocabulary, so their ids are joined."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        simple = pc.match_substring_regex(words, _SIMPLE)
        rest = words.filter(pc.invert(simple))
        parts = pc.extract_regex(rest, _SIGNED)
        both = parts.is_valid()
        parts = parts.filter(both)
        plain = pa.concat_arrays([words.filter(simple), parts.field("base")]).dictionary_encode()
        other = pa.concat_arrays([rest.filter(pc.invert(both)), parts.field("signs")]).dictionary_encode()
        found = [self._together(plain.dictionary), self._one_by_one(other.dictionary)]
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        starts = np.cumsum(sizes) - sizes
        # Of each kind of word, the places among the encoded ones.
        simple, both = (x.to_numpy(zero_copy_only=False) for x in (simple, both))
        first, second = plain.indices.to_numpy(), other.indices.to_numpy() + len(plain.dictionary)
        n_simple, n_other = int(simple.sum()), int((~both).sum())
        of = np.zeros(len(words), np.int64)
        of[simple] = first[:n_simple]
        signed = np.flatnonzero(~simple)[both]
        of[np.flatnonzero(~simple)[~both]] = second[:n_other]
        pairs = np.stack([first[n_simple:], second[n_other:]], axis=1).ravel()
        joined = ids[_places(starts[pairs], sizes[pairs])]
        lengths = sizes[pairs].reshape(-1, 2).sum(axis=1)
        at, n = starts[of], sizes[of]
        at[signed], n[signed] = len(ids) + np.cumsum(lengths) - lengths, lengths
        ids = np.concatenate([ids, joined])
        keep = slice(None) if often is None else often
        self._keep(words if often is None else words.filter(pa.array(often)), ids[_places(at[keep], n[keep])], n[keep])
        return ids, at, n

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and the number of ids of each; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._by_words(texts, end)
        ids, sizes = self._by_words(pc.if_else(pa.array(special), "", texts), end)
        parts, at = [], 0
        for k in np.flatnonzero(special):
            upto = int(sizes[:k].sum())
            whole = np.array([*self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, end], np.uint32)
            parts += [ids[at:upto], whole]
            at = upto + 1
        parts.append(ids[at:])
        own = sizes.copy()
        own[special] = [len(p) for p in parts[1::2]]
        return np.concatenate(parts), own

    def _by_words(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        # Blank and newline part words in any case; other white space is left to the tokenizer.
        lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        flat = lists.flatten().dictionary_encode()
        words, indices = flat.dictionary, flat.indices.to_numpy()
        of = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        old = of >= 0
        starts, sizes = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)  # the last is the end id
        starts[:-1][old], sizes[:-1][old] = self.starts[of[old]], self.sizes[of[old]]
        ids = self.ids
        if not old.all():
            often = np.bincount(indices, minlength=len(words))[~old] >= _OFTEN
            new, at, n = self.learn(words.filter(pa.array(~old)), often)
            starts[:-1][~old], sizes[:-1][~old] = at + len(ids), n
            ids = np.concatenate([ids, new])
        starts[-1], sizes[-1] = len(ids), 1
        ids = np.append(ids, np.uint32(end))
        n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.insert(indices, np.cumsum(n_words), len(words))
        each = sizes[at]
        docs = np.cumsum(n_words + 1) - (n_words + 1)
        return ids[_places(starts[at], each)], (np.add.reduceat(each, docs) if len(docs) else each)


def _called(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and the number of ids of each, from the library; few texts at once, as it returns more than ids."""
    parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for k in range(0, len(texts), _AT_ONCE):
        found = [e.ids for e in tokenizer.encode_batch_fast(texts[k : k + _AT_ONCE], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        parts.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
    return np.concatenate(parts), np.concatenate(sizes)


def _listed(strings: pa.Array) -> list[str]:
    """As to_pylist(), without a scalar for each string."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places start .. start + size - 1, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _FOUND:
        _FOUND[path] = Encoder(path)
    return _FOUND[path]
