"""Text functions as Catalyst expressions.

Tokenising stays inside the JVM: a regex split for alphabetic scripts and
overlapping bigrams for Han runs (a dictionary-free stand-in for a Chinese
segmenter), then the length and stop-word filters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop list of the topic tokenizer (47 words), verbatim and in order.
STOP_WORDS_TOPIC = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "都", "一", "上", "也", "很", "到", "说", "要", "去", "你",
    "会", "着", "没有", "看", "好", "自己", "这", "他", "她",
    "们", "那", "被", "从", "对", "把", "与", "以", "及",
    "等", "但", "而", "或", "又", "如", "所", "之", "其",
]

# The stop list of the keyword extractor (65 words), verbatim and in order.
STOP_WORDS_KEYWORD = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去",
    "你", "会", "着", "没有", "看", "好", "自己", "这", "他", "她",
    "它", "们", "那", "被", "从", "对", "把", "与", "以", "及",
    "等", "但", "而", "或", "又", "如", "所", "之", "其", "这个",
    "那个", "什么", "怎么", "可以", "还是", "因为", "所以",
    "如果", "虽然", "但是", "然后", "已经", "正在", "可能", "应该",
]

# Character-bucket encoding of the sentiment model input.
CHAR_SEQ_LEN = 1500
CHAR_VOCAB = 500

SPLIT_PATTERN = r"[^\p{L}\p{N}]+"
HAN_RUN = r"(\p{IsHan}+)"
HAN_ONLY = r"^\p{IsHan}+$"
HAN_ANY = r"\p{IsHan}"


def _sql_list(words) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _is_han_word(w: str) -> bool:
    r"""Same Unicode script test as the JVM's ``\p{IsHan}``."""
    import regex
    return regex.search(r"\p{Han}", w) is not None


def tokenize(text: Column, stop_words=None, min_len: int = 2) -> Column:
    """Lower-cased tokens of length >= ``min_len`` not in the stop list.

    Letters/digits runs are tokens; a run of Han characters becomes its
    overlapping bigrams.  Returns array<string> (duplicates kept).  A text
    without Han characters takes a plain split; only stop words without Han
    characters can occur in it, so only those are tested there.
    """
    stop = STOP_WORDS_TOPIC if stop_words is None else list(stop_words)
    src = F.coalesce(text, F.lit(""))

    def keep(words):
        arr = F.expr(_sql_list(words)) if words else None
        if arr is None:
            return lambda w: F.length(w) >= min_len
        return lambda w: (F.length(w) >= min_len) & ~F.array_contains(arr, w)

    spaced = F.regexp_replace(src, HAN_RUN, " $1 ")
    parts = F.split(F.lower(spaced), SPLIT_PATTERN)
    grams = F.transform(parts, lambda p: F.when(
        p.rlike(HAN_ONLY) & (F.length(p) >= 2),
        F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, 2)),
    ).otherwise(F.array(p)))
    han_path = F.filter(F.flatten(grams), keep(stop))
    plain_stop = [w for w in stop if not _is_han_word(w)]
    plain_path = F.filter(F.split(F.lower(src), SPLIT_PATTERN), keep(plain_stop))
    return F.when(src.rlike(HAN_ANY), han_path).otherwise(plain_path)


def char_encode(text: Column, seq_len: int = CHAR_SEQ_LEN, vocab: int = CHAR_VOCAB) -> Column:
    """Model input codes: ``code % (vocab - 2) + 2`` per character of the first
    ``seq_len`` characters (the model's fixed input length), zero-padded."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, seq_len)
    chars = F.filter(F.split(head, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: (F.ascii(c) % (vocab - 2)) + 2)
    pad = F.array_repeat(F.lit(0), F.lit(seq_len) - F.size(codes))
    return F.concat(codes, pad)
