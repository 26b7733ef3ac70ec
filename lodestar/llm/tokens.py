"""Token ids by a public tokenizer.

A tokenizer with word ends never merges across white space, so the ids of a text are those of its words in order. The
words of a batch are reduced to distinct ones before anything is looked up, and only words that the worker has not
met go through the merges. Words for which this is not plain to see go through the tokenizer as they are, and so do
all texts of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Words that a worker remembers, and the longest word worth it. Both change time and memory, never the ids.
REMEMBERED, LONGEST = 700_000, 48

# Fixed value: how the word tokenizer's file cuts a text in lower case into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The same for plain characters, where small letters, digits and white space are what Python takes them for.
PLAIN_WORD = re.compile(r"\n|[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")
NOT_PLAIN = "[^\t-\r -~¡-±´-¸º»¿-įı-ɏ]"


class TextIds:
    """Ids of texts under one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.odd = "|".join([NOT_PLAIN, *(re.escape(t["content"]) for t in parts["added_tokens"])])
        pattern = next((p["pattern"]["Regex"] for p in (parts["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        self.by_word = pattern == WORD_PATTERN and parts["model"].get("end_of_word_suffix") == "</w>"
        if self.by_word:
            self.between = np.array([np.iinfo(self.dtype).max], self.dtype)
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words, in one call: each word ends with the one token that ends a word."""
        ids = np.array(self.merges.encode("\n".join(words), add_special_tokens=False).ids, self.dtype)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
        data = ids.tobytes()
        return dict(zip(words, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words one after the other, and how many each has."""
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py()
        parts = PLAIN_WORD.findall(f"{lines}\n".lower() if len(words) else "")
        new = set(parts).difference(self.known, "\n")
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set(parts).difference("\n")
        fresh = list(new)
        for at in range(0, len(fresh), 20_000):
            self.known |= self._learn(fresh[at : at + 20_000])
        self.known["\n"] = self.between.tobytes()
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, parts)), self.dtype)
        for word in fresh:
            if len(word) > LONGEST:
                del self.known[word]
        ends = np.flatnonzero(ids == self.between)
        return ids[ids != self.between], np.diff(ends, prepend=-1) - 1

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none for null."""
        if not self.by_word:
            return [np.frombuffer(self._whole(t or ""), self.dtype) for t in texts.to_pylist()]
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        odd = pc.match_substring_regex(distinct, self.odd).to_numpy(zero_copy_only=False)
        pool, counts = self._plain(distinct.filter(pa.array(~odd)))
        size = np.zeros(len(distinct), np.int64)
        size[~odd] = counts
        pools = [pool]
        for i in np.flatnonzero(odd).tolist():
            pools.append(np.frombuffer(self._whole(distinct[i].as_py()), self.dtype))
            size[i] = len(pools[-1])
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        start = np.zeros(len(distinct), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        index = words.indices.to_numpy()
        length = size[index]
        ends = np.cumsum(length)
        gathered = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[index] - ends + length, length)
        ids = np.concatenate(pools)[gathered]
        return np.split(ids, np.concatenate(([0], ends))[split.offsets.to_numpy()[1:-1]]) if len(texts) else []


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    return TextIds(path)
