"""Byte-level BPE vocabularies read from a tokenizers file, and ids by a ranked encoder.

Ids equal those of the ``tokenizers`` library with add_special_tokens=False: an
added token's string in a text becomes its id, the rest is ordinary text. Only
files of that kind are taken: byte-level BPE without normaliser, prefix space or
other options, token ids in the order of their merges, added tokens that stand
for themselves. Any other file is refused rather than read wrongly.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import warnings

import numpy as np

DEFAULT = "byte_bpe_50k.json"
#: The word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same words where every run of spaces before a word is one space long. Without a look ahead, it is matched in about half the time.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: The last space but one of a longer run before a word, where such a run ends as a word. Python counts four controls as spaces, the patterns don't.
_RUN = re.compile(r"[^\S\x1c-\x1f](?=[^\S\x1c-\x1f][\S\x1c-\x1f])")
#: A special string that is never allowed, so ordinary text. Without any, tiktoken's encoder into arrays stops at every letter to look for none.
NEVER = "<|never|>"


def path_of(name: str = DEFAULT) -> str:
    """A name is looked up among the installed public tokenizers; anything with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse(spec: dict) -> None:
    """ValueError for a tokenizers file that asks for more than this module does."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        ("a model other than BPE", model.get("type", "BPE") != "BPE"),
        ("a normalizer", spec.get("normalizer") is not None),
        ("another pre-tokenizer", before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False),
        ("dropout, byte fallback or affixes", any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))),
        ("whole words before merges", bool(model.get("ignore_merges"))),
        ("added tokens that strip or match words", any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))),
    ]
    if found := [what for what, is_so in wrong if is_so]:
        raise ValueError("not a plain byte-level BPE file: " + ", ".join(found))


class Vocabulary:
    """Token bytes, merge ranks and added tokens of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        self.version = hashlib.sha256(raw.encode()).hexdigest()
        spec = json.loads(raw)
        refuse(spec)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.added = added
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in added.items()}
        self.byte_ids = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        #: (left id, right id) -> (rank, merged id)
        self.merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at added tokens: (ordinary text, None) and (token, id), in order."""
        if self.split is None or not any(t in text for t in self.added):
            return [(text, None)]
        return [(p, self.added.get(p)) for p in self.split.split(text) if p]


@functools.lru_cache(maxsize=4)
def vocabulary(name: str = DEFAULT) -> Vocabulary:
    return Vocabulary(path_of(name))


@functools.lru_cache(maxsize=2)
def _ranked(name: str):
    import tiktoken

    v = vocabulary(name)
    ranks = [merged for _, (_, merged) in sorted(v.merges.items(), key=lambda x: x[1][0])]
    if ranks != sorted(ranks):
        return None  # ids aren't merge ranks: the library itself encodes
    by_rank = {v.token_bytes[i]: i for i in v.token_bytes if i not in set(v.added.values())}
    return tiktoken.Encoding("ranked", pat_str=PLAIN, mergeable_ranks=by_rank, special_tokens={NEVER: max(v.token_bytes) + 1})


@functools.lru_cache(maxsize=2)
def library(name: str = DEFAULT):
    """The tokenizers library on the same file, single-threaded beside Spark's own tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path_of(name))
    t.no_truncation()
    t.no_padding()
    return t


def _apart(text: str) -> list[str]:
    """The text cut where PLAIN would take a space too many."""
    cuts = [m.end() for m in _RUN.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]


def encode_array(text: str, name: str = DEFAULT) -> np.ndarray:
    """The ids of one whole text; the library itself takes texts on which the ranked encoder gives up."""
    fast, out = _ranked(name), []
    if fast is None:
        return np.array(library(name).encode(text, add_special_tokens=False).ids, dtype="<u4")
    for part, special in vocabulary(name).parts(text):
        if special is not None:
            out.append(np.array([special], dtype="<u4"))
            continue
        try:
            out += [fast.encode_to_numpy(p, disallowed_special=()) for p in _apart(part)]
        except BaseException as e:  # limits of its pattern engine on very long runs, which it may raise as a panic
            if not isinstance(e, (ValueError, RuntimeError)) and type(e).__name__ != "PanicException":
                raise
            warnings.warn(f"a text of {len(text)} letters goes to the slower encoder: {e}", RuntimeWarning, stacklevel=2)
            return np.array(library(name).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def encode(text: str, name: str = DEFAULT) -> list[int]:
    """The same as a list."""
    return encode_array(text, name).tolist()
