"""Keyword-stuffed pages, link lists and tag lists.

Each text is cut into blocks of whole lines or words, and every block is
compressed, each target of a link as one mark. The compressed share is set
against what prose of the same length needs, and that against the median of all
blocks of the corpus in the same language and script. A far lower ratio is
extreme redundancy. It is confirmed by a low density of sentences: a sentence has
its punctuation, or the function words of prose where punctuation is lost, and
is not made of the block's own keywords. Lists of code, paths, versions, log
lines and full sentences are as redundant, but hold sentences or the marks of
code, and so they stay. A page is flagged if such blocks make up most of it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import durable

#: Characters of a block.
BLOCK = 600
#: A block is redundant up to this share of the ratio that is usual for its length, language and script.
REDUNDANT = 0.85
#: The usual ratio of a language is its median over the corpus, but at most and at least this; prose of this length in English has 1.
USUAL = (0.4, 1.1)
#: Blocks of ratio 1 that count with those of a language, so that a few blocks do not make its median.
PRIOR_BLOCKS = 50
#: Share of a block in sentences up to which redundancy is confirmed.
SENTENCES = 0.35
#: Share of the content words of a block from which a word is its keyword, and occurrences at least.
KEYWORD, KEYWORD_TIMES = 0.2, 4
#: Share of keywords from which a sentence is none, and of function words from which words without a full stop are prose.
STUFFED, PROSE = 0.25, 0.3
#: Languages whose ratios are broadcast; more are joined.
BROADCAST_LANGUAGES = 10_000
#: Share of a text's characters that must lie in spam blocks.
MOSTLY = 0.5

_URL = re.compile(r"(?:https?://|www\.)[^\s<>()\"'\]]+", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>", re.I | re.S)
_MARKDOWN = re.compile(r"\[([^\[\]]*)\]\([^()]*\)")
_END = re.compile(r"\n|[.!?。！？](?=[\s\"')\]*_`]|$|[^\x00-\x7f])")
_STOPS = frozenset(".!?。！？")
_WRAP = re.compile(r"(?<=[^\W\d_A-Z.]|,)\n[ \t]*(?://+|[#*>+-])*[ \t]*(?=[^\W\d_A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"[{}();=]|\w\.\w|\w/|[|`]--|==|\w_\w|^\s*\w+://", re.M)
_VERSION = re.compile(r"\b[vV]?\d+\.\d+(?:\.\d+)*\b")
_TIME = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
# Function words that prose cannot do without.
_FUNCTION = frozenset(
    "the a an of and to in is that it its as by for from on at with or not but if when until this has have are was were be been any which their they we you "
    "der die das den dem ein eine und ist nicht zu von mit auf im el los las un una de del que y en con para se no le les des est une et dans pour qui sur".split()
)
_PRICE = re.compile(r"\d+[.,]\d\d\s*(?:[A-Z]{3}\b|[$€£])|[$€£]\s*\d")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Pieces of about ``size`` characters that end at a line end or blank where there is one."""
    at = 0
    while at < len(text):
        end = at + size
        if len(text) - end < size // 2:
            end = len(text)
        else:
            cut = max(text.rfind("\n", at + size // 2, end), -1)
            cut = cut if cut > 0 else text.rfind(" ", at + size // 2, end)
            end = cut + 1 if cut > 0 else end
        yield text[at:end]
        at = end


_WIDE = re.compile("[\u3040-\u9fff\uac00-\ud7a3]+")


def dense_script(text: str) -> bool:
    """Whether a third of the text is of a script that writes words in one or two characters."""
    return not text.isascii() and sum(map(len, _WIDE.findall(text))) * 3 > len(text)


def prose_ratio(size: int, dense: bool) -> float:
    """Compressed size that prose of so many bytes needs, as a share; short texts compress less."""
    return min(1.1, (0.44 if dense else 0.376) + 4.65 / math.sqrt(max(size, 1)))


def _marked(block: str, mark: str) -> str:
    """The block with a mark for the target of each link."""
    if "](" in block:
        block = _MARKDOWN.sub(rf"\1 {mark}", block)
    if "<" in block:
        block = _ANCHOR.sub(rf"\1 {mark}", block)
    return _URL.sub(mark, block) if "://" in block or "ww" in block.lower() else block


def block_ratio(block: str, dense: bool) -> float:
    """Compressed size as a share of the block's own, against that of prose of its length."""
    size = len(block.encode("utf-8", "replace"))
    return len(zlib.compress(_marked(block, "\x01").lower().encode("utf-8", "replace"), 6)) / max(size, 1) / prose_ratio(size, dense)


def sentence_share(block: str) -> float:
    """Share of the block's characters that stand in sentences."""
    text = _PRICE.sub("0", _WRAP.sub(" ", _marked(block, " ")))
    words = _WORD.findall(text.lower())
    content = Counter(w for w in words if w not in _FUNCTION)
    least = max(KEYWORD_TIMES, KEYWORD * content.total())
    keywords = {w for w, n in content.items() if n >= least}
    inside = start = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        piece, start = text[start:end], end
        own = _WORD.findall(piece)
        low = [w.lower() for w in own]
        stopped = piece[-1:] in _STOPS
        if dense_script(piece):  # has no blanks between its words
            real = stopped and len(piece.strip()) >= 8
        elif keywords and sum(map(keywords.__contains__, low)) >= STUFFED * len(own):
            real = False
        elif stopped:
            real = len(own) >= 4 and (sum(not w[0].isupper() for w in own) * 2 > len(own) or piece.isupper())
        else:
            real = len(own) >= 8 and sum(map(_FUNCTION.__contains__, low)) >= PROSE * len(own)
        if real:
            inside += len(piece)
    return min(1.0, inside / max(len(block), 1))


def _is_list(block: str) -> bool:
    """Lines of code, versions, paths or a log."""
    lines = [x for x in block.split("\n") if x.strip()]
    text = _marked(block, " ")
    marks = len(_CODE.findall(text)) + len(_VERSION.findall(text)) + 2 * len(_TIME.findall(text)) - 2 * len(_PRICE.findall(text))
    return marks >= 0.5 * len(lines) and marks * 12 >= len(_WORD.findall(text))


def block_features(text: str | None) -> Iterator[tuple[int, bool, float, float, float]]:
    """(characters, dense script, ratio, share in sentences, share in links) of each block that is not blank.

    The density of sentences only matters where a block can be redundant; it is 1 elsewhere.
    """
    for block in blocks(text or ""):
        if not block.strip():
            continue
        dense = dense_script(block)
        ratio, sentences, bare = block_ratio(block, dense), 1.0, _marked(block, " ")
        links = 1 - len(bare.strip()) / len(block.strip())
        if ratio <= REDUNDANT * USUAL[1] and (links >= 0.5 or (_WORD.search(bare) and not _is_list(block))):
            sentences = sentence_share(block)
        yield len(block.strip()), dense, ratio, sentences, links


def usual_ratios(pages: DataFrame) -> DataFrame:
    """(lang, dense, usual): the median ratio of all blocks of a language and script, drawn towards 1 where they are few."""
    groups = pages.select("lang", F.explode("blocks").alias("b")).groupBy("lang", "b.dense").agg(F.percentile_approx("b.ratio", 0.5, 1000).alias("median"), F.count(F.lit(1)).alias("n"))
    drawn = (F.col("median") * F.col("n") + PRIOR_BLOCKS) / (F.col("n") + PRIOR_BLOCKS)
    return groups.select("lang", "dense", F.greatest(F.lit(USUAL[0]), F.least(F.lit(USUAL[1]), drawn)).alias("usual"))


def page_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, blocks): the features of the blocks of each text that is not blank."""
    lang = F.lower(F.coalesce(F.col(lang_col), F.lit(""))) if lang_col in documents.columns else F.lit("")
    rows = documents.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text")).filter("text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    fields = [("size", pa.int32()), ("dense", pa.bool_()), ("ratio", pa.float64()), ("sentences", pa.float64()), ("links", pa.float64())]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_text = [list(block_features(t)) for t in batch.column(2).to_pylist()]
            ends = pa.array([0, *accumulate(map(len, of_text))], pa.int32())
            columns = list(zip(*(b for x in of_text for b in x))) or [()] * len(fields)
            values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, values)], ["id", "lang", "blocks"])

    found = rows.mapInArrow(measure, f"id {kind}, lang string, blocks array<struct<size int, dense boolean, ratio double, sentences double, links double>>")
    return found.filter("size(blocks) > 0")


def spam_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mostly: float = MOSTLY) -> DataFrame:
    """(id, spam_share, sentence_share, link_share) of the pages that are mostly keywords, links or tags.

    Null, empty and blank texts are no case. Repeated rows come out as often as
    they go in; texts of any length are scored whole, block by block. A null
    language is one of its own, and so is that of a table without the column.
    ``sentence_share`` counts blocks that are not redundant as sentences.
    """
    pages = durable(page_blocks(documents, id_col, text_col, lang_col))
    usual = usual_ratios(pages)
    # a page has blocks of both scripts, so each language comes with both of its ratios
    by_lang = durable(usual.groupBy("lang").agg(F.max(F.when(F.col("dense"), F.col("usual"))).alias("of_dense"), F.max(F.when(~F.col("dense"), F.col("usual"))).alias("of_plain")))
    by_lang = F.broadcast(by_lang) if by_lang.count() <= BROADCAST_LANGUAGES else by_lang
    limit = lambda b: REDUNDANT * F.when(b["dense"], F.col("of_dense")).otherwise(F.col("of_plain"))
    share = lambda of: F.aggregate("blocks", F.lit(0.0), lambda acc, b: acc + b["size"] * of(b)) / F.aggregate("blocks", F.lit(0.0), lambda acc, b: acc + b["size"])
    redundant = lambda b: b["ratio"] <= limit(b)
    scored = pages.join(by_lang, "lang").select(
        F.col("id").alias(id_col),
        share(lambda b: F.when(redundant(b) & (b["sentences"] <= SENTENCES), 1.0).otherwise(0.0)).alias("spam_share"),
        share(lambda b: F.when(redundant(b), b["sentences"]).otherwise(1.0)).alias("sentence_share"),
        share(lambda b: b["links"]).alias("link_share"),
    )
    return scored.filter((F.col("spam_share") >= mostly) & (F.col("sentence_share") < 0.4))


def spam_score(text: str | None, usual: float = 1.0) -> tuple[float, float, float]:
    """(share of the text in spam blocks, share in sentences, share in links) of one text, where its language has the ratio ``usual``."""
    found = [(size, ratio <= REDUNDANT * usual, sentences, links) for size, _, ratio, sentences, links in block_features(text)]
    total = sum(f[0] for f in found)
    if not total:
        return 0.0, 0.0, 0.0
    spam = sum(size for size, redundant, sentences, _ in found if redundant and sentences <= SENTENCES)
    return spam / total, sum(size * (sentences if redundant else 1.0) for size, redundant, sentences, _ in found) / total, sum(f[0] * f[3] for f in found) / total
