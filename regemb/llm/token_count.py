"""Token counts with a whole-token shortcut (operator 7).

The counted tokenizer is a BPE with word ends behind a fixed pre-tokenizer
(letters run, single digit, run of other signs, English contractions).  Each
pre-token is merged alone, so the count of a text is the sum over its
pre-tokens, and

* **offline proof:** every vocabulary string that ends a word is encoded alone
  by the library once; those that give exactly one token form the whole-token
  set;
* **counting:** pre-tokens in that set count one each, straight from a lookup;
* **the rest** is merged by the library, each distinct pre-token once per
  task, and remembered in a bounded table (``MEMORY`` entries; when full it is
  emptied, results do not change).

Normalisation follows the tokenizer: NFC, white space to one blank, lower case
letter by letter (so a final sigma stays an ordinary one).  A text that holds a special-token string
goes to the library whole, because the library cuts at such strings first.

Null counts as empty, empty text has no tokens.  There is no truncation and no
limit on length.  Repeated rows count alike, extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regemb.llm.base import id_and_text

LIMIT = 2048
MEMORY = 1_000_000
# The tokenizer's own pre-token pattern and special strings.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SIGMA = str.maketrans({"Σ": "σ"})


class Counter:
    """Counts tokens of whole texts as the library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(PRE_TOKEN)
        self.counts = self.whole_tokens()
        self.size = len(self.counts)

    def whole_tokens(self) -> dict[str, int]:
        """Pre-tokens proved to be one token each."""
        decoded = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        words = [t[:-4] for t in decoded if t and t.endswith("</w>") and t[:-4].isascii()]
        words = [w for w in words if self.pattern.fullmatch(w) and w == w.lower()]
        return {w: 1 for w, e in zip(words, self._encode(words), strict=True) if e == 1}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.translate(_SIGMA)
        return self.pattern.findall(text.lower())

    def count(self, texts: list[str]) -> list[int]:
        known = self.counts
        if len(known) > self.size + MEMORY:
            known = self.counts = self.whole_tokens()
        pieces: list[list[str] | None] = []
        rest: set[str] = set()
        for t in texts:
            if any(s in t for s in SPECIAL):
                pieces.append(None)
                continue
            p = self.pre_tokens(t)
            pieces.append(p)
            rest.update(w for w in set(p) if w not in known)
        new = list(rest)
        known.update(zip(new, self._encode(new), strict=True))
        return [self._encode([t])[0] if p is None else sum(map(known.__getitem__, p))
                for t, p in zip(texts, pieces, strict=True)]


def _kernel(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            n: list[int] = []
            for i in range(0, len(texts), 256):
                n += counter.count(texts[i:i + 256])
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"),
                "n_tokens": pa.array(n, pa.int64())})
    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    t = id_and_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return (t.mapInArrow(_kernel(path), "doc_id long, n_bytes long, n_tokens long")
             .withColumn("over_limit", F.col("n_tokens") > limit))
