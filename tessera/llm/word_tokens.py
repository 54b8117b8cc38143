"""Token ids of whole texts with a tokenizer that drops white space, word by word with a bounded cache.

A tokenizer whose pre-tokenizer keeps only matches of a pattern, none of which holds white space, gives the same ids for a text as for its words
apart. Words of one batch that the cache lacks are encoded together and told apart by their offsets. Any other tokenizer encodes texts whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .memo import Memo

#: Of each line letters, then marks: two matches of the pattern that any case and company leaves the same; or else anything. "<" opens special tokens,
#: "'" joins letters.
_PLAIN = re.compile(r"^(?:([a-zß-öø-ÿ]*)([.,!?;:|%&$#*]*)|(.+))$", re.M)


class WordEncoder:
    def __init__(self, path: str, room: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        first, *rest = before.get("pretokenizers") or [before]
        self.by_word = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and not re.search(r"(?<!\^)\\s", first["pattern"].get("Regex", " "))
        self.memo, self.parts = Memo(room), Memo(room)
        if self.by_word:  # for runs of letters or marks that are normalised and split already: the same model behind other steps
            steps = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}
            bare = spec | {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": steps, "model": {"type": "BPE", "vocab": {}, "merges": []}}
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = Tokenizer.from_str(json.dumps(bare)).pre_tokenizer

    def _learn_parts(self, parts: list[str]) -> None:
        """Put the ids of new lower-case letter runs and mark runs into their cache."""
        young = self.parts.young
        groups = [parts[i : i + 256] for i in range(0, len(parts), 256)]
        for group, code in zip(groups, self.plain.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            data, starts = np.array(code.ids, "<u4").tobytes(), np.array(code.offsets, np.int64).reshape(-1, 2)[:, 0]
            firsts = np.cumsum([0] + [len(w) + 1 for w in group])
            cuts = (4 * np.searchsorted(starts, firsts)).tolist()
            for w, a, b in zip(group, cuts, cuts[1:]):
                young[w] = data[a:b]

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words into the cache."""
        if not words:
            return
        young, found = self.memo.young, _PLAIN.findall("\n".join(words).lower())
        self.parts.turn()
        parts = {a for a, _, _ in found}
        parts.update([b for _, b, _ in found])
        parts.discard("")
        self._learn_parts(self.parts.missing(parts))
        known = self.parts.young
        known[""] = b""
        young.update(zip(words, [known[a] + known[b] if b else known[a] for a, b, _ in found]))
        odd = [w for w, (_, _, x) in zip(words, found) if x]
        for w, code in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
            young[w] = np.array(code.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [np.array(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.memo.turn()
        self._learn(self.memo.missing(set().union(*split)))
        of = self.memo.young.__getitem__
        return [b"".join(map(of, words)) for words in split]
