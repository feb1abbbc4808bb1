"""Token counts (operator 5): whole-token shortcut over a byte-level BPE vocabulary.

*Offline*, each vocabulary string is proved to encode alone as its own single token
(:func:`whole_tokens`).  *Online*, a text is cut at single spaces into chunks that byte-level
pre-tokenisation treats independently; a chunk's pre-tokens that are whole tokens count one each
without any merging, only the others go through a merge table.  Chunks repeat, so their results are
kept in a bounded table for each Python worker.

Merging is by rank: in this vocabulary ids are given in the order of the merges, which is checked
when the file is read (:func:`merge_table`), so the lowest id among the possible merges is the next
one.  Where that does not hold, or a chunk has characters beyond the basic plane, the library's own
encoder is used instead.

Why a cut at a space is exact: a pre-token never holds a space except as its first character or
inside a run of white space.  A space between two characters that are not white space therefore
starts a pre-token, and so does each space of a run of two.  Longer runs, and runs of two at the end
of a text, are pre-tokens of their own; such texts, and those with a special string, go through the
library whole.
"""

from __future__ import annotations

import array
import json
import os
import re

from notewright.llm import common

#: The split pattern of byte-level BPE of this vocabulary family.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Everything that any of the regex engines at hand takes for white space.
SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run that a cut could break: a space between spaces, or after one at the end of the text.
RUN = re.compile(f"[{SPACES}]{{3}}|[{SPACES}]{{2}}\\Z")
#: Characters of chunks that a worker remembers before it forgets all and starts again.
REMEMBERED_CHARS = 14 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file of the public tokenizers is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary strings that, alone, are one pre-token and encode as one token: text to id.

    Bounded by the vocabulary (some 50,000 short strings), whatever the corpus.
    """
    import regex

    tokenizer, pretoken = load(path), regex.compile(PRETOKEN)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    size = tokenizer.get_vocab_size()
    named = [(i, tokenizer.decode([i], skip_special_tokens=False)) for i in range(size)]
    named = [(i, s) for i, s in named if s and "�" not in s and s not in special]
    found = tokenizer.encode_batch_fast([s for _, s in named], add_special_tokens=False)
    return {s: i for (i, s), e in zip(named, found, strict=True) if e.ids == [i] and pretoken.findall(s) == [s]}


def merge_table(path: str):
    """A byte-pair encoder made of the vocabulary file, or None if its ids do not follow its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # The printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for
    # themselves, the others for the code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(made) or len(set(made)) != len(made):
        return None
    merged = set(made)
    ranks = {bytes(stand_in[c] for c in t): i for t, i in vocab.items() if all(c in stand_in for c in t) and (len(t) == 1 or i in merged)}
    return tiktoken.Encoding("merges", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class Chunks(dict):
    """Token ids or counts of whole texts; as a dict, the results of the chunks seen so far.

    ``ids=True`` keeps each chunk's ids as little-endian unsigned 32-bit bytes, else its count.  A
    chunk's key is its text without the space before it; the first chunk of a text, which has none,
    has the sign \\0 instead.
    """

    def __init__(self, path: str, whole: dict[str, int], ids: bool = False):
        import regex

        super().__init__()
        self.tokenizer, self.pretokens, self.merge = load(path), regex.compile(PRETOKEN).findall, merge_table(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids, self.whole, self.chars = ids, whole, 0

    def packed(self, ids: list[int]):
        return array.array("I", ids).tobytes() if self.ids else len(ids)

    def library(self, text: str):
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, key: str):
        chunk = key[1:] if key[:1] == "\0" else " " + key
        whole = self.whole.get(chunk)
        if whole is not None:
            result = self.packed([whole])
        elif self.merge is None or (chunk and max(chunk) > "\uffff"):
            result = self.library(chunk)
        elif self.ids:
            result = self.packed(self.merge(chunk))
        else:
            pre = self.pretokens(chunk)
            result = sum(1 if p in self.whole else len(self.merge(p)) for p in pre)
        self[key] = result
        self.chars += len(key) + 16
        return result

    def texts(self, texts: list[str]) -> list:
        """One result for each text, in order."""
        add, get, out = b"".join if self.ids else sum, self.__getitem__, []
        for t in texts:
            if self.chars > REMEMBERED_CHARS:
                self.clear()
                self.chars = 0
            single = len(t.split()) == t.count(" ") + t.count("\n") + 1
            if "\0" in t or (not single and RUN.search(t)) or any(s in t for s in self.special):
                out.append(self.library(t))
            else:
                parts = t.split(" ")
                parts[0] = "\0" + parts[0]
                out.append(add(map(get, parts)))
        return out


def worker_chunks(path: str, whole: dict[str, int], ids: bool) -> Chunks:
    """One table for each Python worker: it serves all tasks that the worker runs."""
    return common.held(("chunks", path, ids), lambda: Chunks(path, whole, ids))
