"""Small tables with the awkward rows every operator must stand, and brute-force versions."""

import random
import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, as further columns.
CLASHES = ["size", "rank", "key", "node", "line", "n_tokens", "target", "gone_lines", "gone_id", "gone_hash", "line_total",
           "line_removed", "line_text_hash", "mix_copies", "mix_copy", "mix_row_hash", "row_hash", "lm_lang", "lm_cost", "lm_limit",
           "kept_id", "comp", "size_band"]
EXTRA = ["z"] * len(CLASHES)
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in CLASHES]])


def rows():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(120)] + ["Ünï", "日本", "it's", "<s>", "x\x0by"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, lead = text(60), text(9)
    base = text(80)
    near = base.split()
    near[40] = "changed"
    long = "\n".join(text(40) for _ in range(150))
    texts = [None, "", " \t\n ", "one", "one", "One two three", "one TWO three", base, base, " ".join(near), base.upper(),
             text(20) + "\n" + shared + "\n" + text(15), lead + "\n" + text(30) + " " + shared, shared, lead + "\n" + text(25),
             long, long, text(3) + "  double  spaces \r\n\r\n tabs\t\there ", "a" * 3000, "word " * 400, "\n\n\n", "<|endoftext|> <s> ▁▁x", "😀  nbsp",
             "l one\nl two\nl three", "x\nl two\nl three", "l two\nl three"]
    texts += [text(rng.randint(1, 60)) for _ in range(30)]
    out = []
    for i, t in enumerate(texts):
        src = None if i % 11 == 5 else ("hot" if i % 3 == 0 else f"s{i % 4}")
        out.append((i, t, None if i % 13 == 4 else ("en" if i % 2 else "fr"), src, len(t or ""), *EXTRA))
    out.append((7, base, "en", "hot", len(base), *EXTRA))  # a repeated id
    out.append((None, shared + " " + text(5), "en", "s1", 0, *EXTRA))  # no id
    return out


def docs(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA)


def words(text, lower=False):
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", data.lower() if lower else data)


def collect(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=repr)
