"""Text to vector: tokens, word pieces, hashed vectors and model encoders."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed value, the same in Java's and Python's dialect: a run of neither ASCII space nor punctuation, or one punctuation sign.
TOKEN = r"[^\t\n\f\r \p{P}]+|\p{P}"
MOST_TOKENS = 512
PROFILES = ("bert_tokenized_mean_pooling", "string_input_direct")


def basic_tokens(text: Column, lower: bool = False) -> Column:
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), 0)


def read_vocabulary(data: str) -> tuple[dict[str, int], bool]:
    """Token ids and whether text is lower-cased, from a tokenizer file or a list of tokens."""
    if data.lstrip().startswith("{"):
        doc = json.loads(data)
        vocab = {str(k): int(v) for k, v in doc["model"]["vocab"].items()}
        lower = (doc.get("normalizer") or {}).get("type") == "Lowercase"
    else:
        vocab = {line.rstrip("\r"): i for i, line in enumerate(data.split("\n")) if line.rstrip("\r")}
        lower = False
    missing = [t for t in ("[UNK]", "[CLS]", "[SEP]") if t not in vocab]
    if missing:
        raise ValueError(f"vocabulary lacks {', '.join(missing)}")
    return vocab, lower


def longest_piece(vocab: dict[str, int]) -> int:
    """Bytes of the longest piece without its sign."""
    return max((len(p.removeprefix("##").encode()) for p in vocab), default=0)


def word_pieces(word: str, vocab: dict[str, int], longest: int | None = None) -> list[str]:
    """The longest known pieces from the left; a word with a part unknown is unknown as a whole.
    No piece longer than ``longest`` bytes (all that the vocabulary has) is tried."""
    raw, at, out = word.encode("utf-8", "surrogatepass"), 0, []
    longest = longest_piece(vocab) if longest is None else longest
    while at < len(raw):
        for end in range(min(len(raw), at + max(longest, 2)), at, -1):
            piece = ("##" if at else "") + raw[at:end].decode("utf-8", "replace")
            if piece in vocab:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out


def wordpiece_udf(vocab: dict[str, int], most: int = MOST_TOKENS):
    """A pandas UDF from tokens to struct<input_ids, attention_mask, token_type_ids>."""
    known: dict[str, list[int]] = {}
    longest = longest_piece(vocab)

    def ids(word: str) -> list[int]:
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = [vocab[p] for p in word_pieces(word, vocab, longest)]
        return known[word]

    @F.pandas_udf("input_ids array<long>, attention_mask array<long>, token_type_ids array<long>")
    def encode(tokens: pd.Series) -> pd.DataFrame:
        rows = []
        for words in tokens:
            inner = [i for w in (words if words is not None else ()) for i in ids(w)][: most - 2]
            row = [vocab["[CLS]"], *inner, vocab["[SEP]"]]
            rows.append((row, [1] * len(row), [0] * len(row)))
        return pd.DataFrame(rows, columns=["input_ids", "attention_mask", "token_type_ids"])

    return encode


def padded(rows: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of a batch, filled with 0 to its longest row."""
    width = max(map(len, rows), default=0)
    ids, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        ids[i, : len(r)], mask[i, : len(r)] = r, 1
    return ids, mask


def l2_rows(v: np.ndarray) -> np.ndarray:
    """Rows in unit length as floats; zero rows stay."""
    v = v.astype(np.float32)
    size = np.sqrt((v * v).sum(1, dtype=np.float32, keepdims=True))
    return np.where(size > 0, v / np.where(size > 0, size, 1), v).astype(np.float32)


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the tokens' states under the mask, in unit length."""
    m = mask[:, :, None].astype(np.float32)
    total = (hidden.astype(np.float32) * m).sum(1)
    return l2_rows(total / np.maximum(m.sum(1), 1))


def decode_output(output: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Sentence vectors (two axes) in unit length, or token states (three axes) pooled."""
    if output.shape[:1] != mask.shape[:1] or output.ndim not in (2, 3):
        raise ValueError(f"unexpected model output {output.shape}")
    return l2_rows(output) if output.ndim == 2 else mean_pool(output, mask)


def check_assets(model_path: str, profile: str, vocabulary_path: str, dimension: int) -> None:
    """Raises ValueError unless the model, and the vocabulary where the profile needs one, are files that hold something."""
    if profile not in PROFILES:
        raise ValueError(f"unknown model profile {profile!r}")
    if dimension <= 0:
        raise ValueError(f"the vector dimension must be positive, not {dimension}")
    for name, path in [("model", model_path)] + [("vocabulary", vocabulary_path)] * (profile == PROFILES[0]):
        path = (path or "").strip()
        if not path:
            raise ValueError(f"the {name} path is empty (profile {profile!r})")
        if not os.path.exists(path):
            raise ValueError(f"the {name} {path!r} does not exist")
        if os.path.isdir(path):
            raise ValueError(f"the {name} {path!r} is a folder")
        if not os.path.getsize(path):
            raise ValueError(f"the {name} {path!r} is empty")


def file_hash(path: str) -> str:
    """SHA-256 of a model file in hexadecimal digits: its ``model_hash`` where none is set."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def pick_name(names: Sequence[str], wanted: str, *usual: str) -> str:
    """``wanted`` if it is set, which must then exist, else the first usual name, else the first of all."""
    if wanted:
        if wanted not in names:
            raise ValueError(f"the model has no {wanted!r} among {', '.join(names)}")
        return wanted
    return next((n for n in usual if n in names), names[0])


class Session:
    """An ONNX session, opened when it is first used and again after it failed."""

    def __init__(self, path: str):
        self.path, self.opened = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "opened": None}

    def open(self):
        if self.opened is None:
            import onnxruntime

            self.opened = onnxruntime.InferenceSession(self.path)
        return self.opened

    def run(self, output: str, feed: dict) -> np.ndarray:
        try:
            return self.open().run([output], feed)[0]
        except Exception:
            self.opened = None
            raise


def onnx_encoder(path: str, vocab: dict[str, int] | None, lower: bool = False, profile: str = PROFILES[0], input_name: str = "", output_name: str = "", session: Session | None = None) -> Callable[[list[str]], np.ndarray]:
    """An encoder of an ONNX model, whose session is opened once in each Python worker.

    With the profile ``bert_tokenized_mean_pooling`` texts go in as token ids of ``vocab``, with
    ``string_input_direct`` as they are.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown model profile {profile!r}")
    model = session or Session(path)
    longest = longest_piece(vocab or {})

    def direct(texts: list[str]) -> np.ndarray:
        opened = model.open()
        name = pick_name([i.name for i in opened.get_inputs()], input_name)
        output = pick_name([o.name for o in opened.get_outputs()], output_name, "sentence_embedding")
        out = np.asarray(model.run(output, {name: np.array(texts, object)}), np.float32)
        if not texts or out.size % len(texts):
            raise ValueError(f"unexpected model output of {out.size} numbers for {len(texts)} texts")
        return l2_rows(out.reshape(len(texts), -1))

    def tokenized(texts: list[str]) -> np.ndarray:
        import regex

        opened = model.open()
        find = regex.compile(TOKEN).findall
        rows = [[vocab["[CLS]"], *[vocab[p] for w in find(t.lower() if lower else t) for p in word_pieces(w, vocab, longest)][: MOST_TOKENS - 2], vocab["[SEP]"]] for t in texts]
        ids, mask = padded(rows)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        names = {i.name for i in opened.get_inputs()}
        output = pick_name([o.name for o in opened.get_outputs()], output_name, "sentence_embedding", "last_hidden_state")
        return decode_output(model.run(output, {k: v for k, v in feed.items() if k in names}), mask)

    return direct if profile == PROFILES[1] else tokenized


def encode_messages(messages: DataFrame, encoder: Callable[[list[str]], np.ndarray], dimension: int, batch_size: int = 32) -> DataFrame:
    """Adds ``embedding``; texts go to the encoder in batches, in order, and its output is checked."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(text), batch_size):
            part = text.iloc[at : at + batch_size].tolist()
            v = np.asarray(encoder(part))
            if v.shape != (len(part), dimension) or not np.isfinite(v).all() or (v == 0).all(1).any():
                raise ValueError(f"the encoder gave {v.shape} for {len(part)} texts of dimension {dimension}, or unusable vectors")
            out.extend(v.astype(np.float32))
        return pd.Series(out)

    return messages.withColumn("embedding", embed("text"))


def token_hash_embed(rows: DataFrame, key: str, text: str, dimension: int) -> DataFrame:
    """``key, bucket, weight``: the unit vector of hashed tokens in sparse form, by built-in functions."""
    tokens = rows.select(key, F.explode(basic_tokens(F.lower(text))).alias("token"))
    bucket = F.pmod(F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long"), F.lit(dimension))
    counted = tokens.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # A key has at most ``dimension`` rows here.
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(key)))
    return counted.select(key, "bucket", (F.col("n") / size).alias("weight"))
