"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that ends its encoding. An automaton over the
vocabulary names, for each position, the tokens that are suffixes of the prefix (longest first); a
candidate is right if it and the last token of the prefix before it would stay apart when merged by rank.
Following the stored last tokens back from the end gives the exact ids.
"""

from __future__ import annotations

import hashlib
import json
import re as stdre
import unicodedata
from array import array
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonlake.llm.common import map_rows

END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in plain else extra))
        extra += b not in plain
    return letters


class PrefixBpe:
    """Encoder and decoder of a word-end BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, spec: dict, cached: int = 200_000):
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or spec.get("decoder") or spec.get("post_processor") or model.get("continuing_subword_prefix"):
            raise ValueError("only BPE with word ends and no decoder or post-processor is supported")
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in added.items()}}
        self.added = added
        self.special = stdre.compile("(" + "|".join(stdre.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.letters = byte_letters()
        as_byte = {c: b for b, c in enumerate(self.letters)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Rank of the merge that makes a token from two; rank and halves by token; single symbols have rank -1.
        self.joined: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, -1, -1) for i in vocab.values()}
        for rank, (a, b) in enumerate(pairs):
            whole = a + b
            self.joined[vocab[a], vocab[b]] = rank
            if self.made[vocab[whole]][0] < 0:
                self.made[vocab[whole]] = (rank, vocab[a], vocab[b])
        self._build(vocab, as_byte)
        self.apart: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cached = cached

    def _build(self, vocab: dict[str, int], as_byte: dict[str, int]) -> None:
        """Trie of the token bytes with failure links; each state has its token inside a word, its token at a word's end, and the next state down the suffixes that has any."""
        goto: list[dict[int, int]] = [{}]
        inner, final = [-1], [-1]
        for token, i in vocab.items():
            ends = token.endswith(END)
            state = 0
            for c in token[: -len(END)] if ends else token:
                b = as_byte[c]
                if b not in goto[state]:
                    goto[state][b] = len(goto)
                    goto.append({})
                    inner.append(-1)
                    final.append(-1)
                state = goto[state][b]
            (final if ends else inner)[state] = i
        fail, below, depth = [0] * len(goto), [0] * len(goto), [0] * len(goto)
        queue = list(goto[0].values())
        for s in queue:
            depth[s] = 1
        for s in queue:
            for b, t in goto[s].items():
                f = fail[s]
                while f and b not in goto[f]:
                    f = fail[f]
                fail[t] = goto[f].get(b, 0)
                depth[t] = depth[s] + 1
                queue.append(t)
            f = fail[s]
            below[s] = f if inner[f] >= 0 or final[f] >= 0 else below[f]
        self.goto, self.fail, self.below, self.depth, self.inner, self.final = goto, fail, below, depth, inner, final

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two neighbours as they are. The tokens' own merges are undone from the
        latest on; a pair that meets at the border must not have a merge that comes before what was undone last."""
        key = (left, right)
        if (known := self.apart.get(key)) is not None:
            return known
        made, joined = self.made, self.joined
        a, b = left, right
        a_bound = b_bound = 1 << 60  # the step at which the piece next to the border is merged into what stood before
        ok = True
        while True:
            rank = joined.get((a, b))
            # Both pieces exist from their own merge until they are merged further; of equal ranks the one on the left comes first.
            if rank is not None and rank < a_bound and rank <= b_bound:
                ok = False
                break
            ra, rb = made[a][0], made[b][0]
            if ra < 0 and rb < 0:
                break
            # The later of the two merges is undone; equal ranks: the right one is done after the left one.
            if ra > rb:
                a_bound, a = ra, made[a][2]
            else:
                b_bound, b = rb, made[b][1]
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        self.apart[key] = ok
        return ok

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        goto, fail, below, depth, inner = self.goto, self.fail, self.below, self.depth, self.inner
        n, state = len(data), 0
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for i, b in enumerate(data, 1):
            while state and b not in goto[state]:
                state = fail[state]
            state = goto[state].get(b, 0)
            tokens = self.final if i == n else inner
            s = state
            while s:
                t = tokens[s]
                if t >= 0:
                    at = i - depth[s]
                    if at == 0 or (last[at] >= 0 and self.stays_apart(last[at], t)):
                        last[i], start[i] = t, at
                        break
                s = below[s]
        ids, at = [], n
        while at > 0:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks a byte")
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    def pieces(self, text: str) -> Iterator[str]:
        """Pre-tokens of a stretch without added tokens, after NFC, white space and lower case."""
        text = unicodedata.normalize("NFC", text)
        if text.isascii():
            text = text.lower()
        else:
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return self.pattern.findall(text)

    def encode(self, text: str | None) -> array:
        """Ids as the tokenizers library gives them without special tokens around; none for null."""
        out = bytearray()
        cache = self.cache
        for k, part in enumerate(self.special.split(text) if text and self.special else [text or ""]):
            if k % 2:
                out += array("I", [self.added[part]]).tobytes()
                continue
            for p in self.pieces(part):
                ids = cache.get(p)
                if ids is None:
                    ids = array("I", self.word(p.encode("utf-8", "surrogatepass"))).tobytes()
                    if len(p) <= 64:
                        if len(cache) >= self.cached:
                            cache.clear()
                        cache[p] = ids
                out += ids
        return array("I", bytes(out))

    def decode(self, ids) -> str:
        """The tokens of ids joined by spaces, as the library joins them where a vocabulary has no decoder; unknown ids are left out."""
        return " ".join([t for t in map(self.names.get, ids) if t is not None])


_made: dict[str, PrefixBpe] = {}


def of(text: str) -> PrefixBpe:
    """The codec of a vocabulary file's text, made once in each Python process."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = PrefixBpe(json.loads(text))
    return _made[key]


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with an array column of ids and, if asked for, the text decoded from them. Null is encoded as empty; every other
    column stays as it is. The vocabulary file is read by the driver and sent to the executors once (its size is that of the
    file, a few MB). Columns named as the new ones, in whatever case, are replaced. Repeated rows are encoded each; an empty table gives no rows."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    others = [c for c in docs.columns if c.lower() not in {ids.lower(), (decoded or ids).lower()}]
    if text not in others:
        raise ValueError(f"the new columns can't replace {text}")
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = T.StructType([*docs.select(*others).schema.fields, *new])

    def rows(part):
        codec = of(sent.value)
        found = [codec.encode(t) for t in part[text]]
        yield {**part, ids: found} | ({decoded: [codec.decode(x) for x in found]} if decoded else {})

    return map_rows(docs.select(*others), rows, schema, slices=200)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, repeated rows included; null is encoded as empty, and a null id stays null. Ids and decoded text are made row by row and only their digests leave the task."""
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(part):
        codec = of(sent.value)
        counts, ids_hex, text_hex = [], [], []
        for t in part["text"]:
            ids = codec.encode(t)
            if ids.itemsize != 4:
                raise ValueError("this machine has no 4-byte unsigned integers")
            counts.append(len(ids))
            ids_hex.append(hashlib.sha256(ids.tobytes()).hexdigest())
            text_hex.append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        yield {"doc_id": part["doc_id"], "n_tokens": counts, "ids_sha256": ids_hex, "decoded_sha256": text_hex}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
