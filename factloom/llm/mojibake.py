"""Problem 8: text decoded with a wrong character encoding.

Words are maximal runs of letters and non-ASCII characters that hold at least one non-ASCII character; inline code (between single
backticks) is cited text and is left out. Every distinct clean corpus word is garbled under every encoding chain (what one would read
had its bytes been decoded wrongly, once or several times, strictly or with losses), and the distinct words of the documents are
hash-joined against this table. A match is verified: the original must be told apart from chance by its length, and, unless
the chain starts from UTF-8 (whose byte patterns do not arise by chance) or the garbled form holds control or replacement characters
(which no genuine word does), occur in more distinct texts than the garbled form. Matches in equally many texts, and those of short words, count
where a document has several of one chain whose garbled forms look less like words than their originals.

Cases: null and empty texts have no words; a garbled word whose original occurs nowhere is not found by itself, but the rest of its
stretch is; originals that a lossy chain cannot tell apart count as found but are not restored; equal texts are judged alike; an
empty table gives an empty result. Everything runs on distinct words with their document counts; the words of a document are joined
back to the verified table, which is broadcast only while its size is small (else salted), so a word in every document is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from unicodedata import category, normalize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import lookup, materialize, spread

#: code pages of one byte, in which text is often stored or misread
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp850", "cp437", "mac_roman", "koi8_r", "iso8859_2", "iso8859_15", "cp866", "cp852", "iso8859_5", "cp1254", "cp1253", "mac_cyrillic", "cp855", "cp1257", "iso8859_7")
MULTI = ("cp949", "cp932", "euc_jp", "gbk", "big5")
#: wrong readings of UTF-8 that are often stored as UTF-8 again
AGAIN = (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("cp1252", "latin-1"), ("latin-1", "cp1252"), ("mac_roman", "mac_roman"), ("cp850", "cp850"), ("cp437", "cp437"), ("cp1252", "cp1252", "cp1252"))

INLINE_CODE = r"(?<!`)`[^`\n]+`(?!`)"
_SEPARATORS = "".join(chr(c) for c in range(128) if chr(c) != " " and not chr(c).isalpha())
WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f](?:[A-Za-z]|[^\x00-\x7f])*")
CODE = re.compile(INLINE_CODE)
_CJK = re.compile(r"[\u1100-\u11ff\u3000-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_UNCLEAN = re.compile(r"[\x80-\x9f\ufffd]")
#: what matches of one chain that prove nothing alone need in a document: distinct words, and letters of their originals
TOGETHER, LETTERS = 2, 8


@cache
def _page(name: str) -> tuple[list[str], list[str], frozenset[int]]:
    """Characters of the 256 bytes with undefined bytes passed through, with them lost, and the undefined bytes."""
    sloppy, lossy, gaps = [], [], []
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = None
            gaps.append(b)
        sloppy.append(chr(b) if c is None else c)
        lossy.append("\ufffd" if c is None else c)
    return sloppy, lossy, frozenset(gaps)


@cache
def _translate(name: str, lossy: bool) -> dict[int, str]:
    return dict(enumerate(_page(name)[1 if lossy else 0]))


def _readings(data: bytes, name: str) -> list[str]:
    raw = data.decode("latin-1")
    out = [raw.translate(_translate(name, False))]
    if not _page(name)[2].isdisjoint(data):
        out.append(raw.translate(_translate(name, True)))
    return out


def is_clean(word: str) -> bool:
    """Whether a word may serve as an original: it has no control or replacement characters and is no wrong reading of UTF-8."""
    if _UNCLEAN.search(word):
        return False
    for page in ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250"):
        try:
            # a lone accented letter before a symbol may be genuine; two continuation patterns or three bytes are not
            if len(back := word.encode(page).decode("utf-8")) < len(word) and any(c > "\x7f" for c in back):
                return False
        except UnicodeError:
            continue
    return True


def oddity(word: str) -> int:
    """How little a word looks like one: its non-ASCII characters that are no letters, ligatures or modifiers, and capitals after small letters."""
    return sum(c > "\x7f" and (category(c) not in ("Ll", "Lu", "Lo") or normalize("NFKC", c) != c) for c in word) + sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


def garbled_forms(word: str, weak: dict[str, list[str]] | None = None) -> dict[str, tuple[str, bool]]:
    """garbled word -> (chain, whether the original must be the more frequent of the two). weak takes the forms that are too short to
    prove anything by themselves, with their chains."""
    out: dict[str, tuple[str, bool]] = {}
    letters = sum(c.isalpha() for c in word)
    wide = bool(_CJK.search(word))

    def emit(texts: list[str], chain: str, frequent: bool, least: int = 1) -> None:
        for t in texts:
            for g in WORD.findall(t):
                if g != word and sum(c > "\x7f" for c in g) >= least:
                    old = out.get(g)
                    doubted = frequent and not (len(g) > 1 and _UNCLEAN.search(g))
                    if old is None or (old[1] and not doubted):
                        out[g] = (chain, doubted)

    utf8 = word.encode("utf-8")
    for page in SINGLE:
        emit(_readings(utf8, page), f"utf-8>{page}", False, 2)
    for pages in AGAIN:
        texts = [word]
        for page in pages:
            texts = [r for t in texts for r in _readings(t.encode("utf-8"), page)]
        emit(texts, ">".join(f"utf-8>{p}" for p in pages), False, 2)
    emit([utf8.decode("ascii", "replace")], "utf-8>ascii", True)
    for page in MULTI:
        emit([utf8.decode(page, "replace")], f"utf-8>{page}", True, 3)
    for page in SINGLE + (MULTI if wide else ()):
        try:
            data = word.encode(page)
        except UnicodeError:
            continue
        lost = data.decode("utf-8", "replace")
        if "\ufffd" in lost:
            emit([lost, data.decode("ascii", "replace")], f"{page}>utf-8", True)
        many = page in MULTI
        if many or letters >= 4:
            for other in SINGLE:
                if other != page:
                    emit(_readings(data, other), f"{page}>{other}", True, 4 if many else 1)
        elif weak is not None:
            for other in SINGLE:
                if other != page:
                    for g in _readings(data, other):
                        if g != word and WORD.fullmatch(g):
                            weak.setdefault(g, []).append(f"{page}>{other}")
        if many:
            for other in MULTI:
                if other != page:
                    emit([data.decode(other, "replace")], f"{page}>{other}", True, 4)
    return out


FORMS = "garbled string, original string, chain string, frequent boolean, short boolean, odd int, letters int, df bigint, copies bigint"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forms of the words of a batch: those that prove a wrong reading, and (short) those that only fit a proven one. odd: by
    how much the form looks less like a word than its original."""
    for b in batches:
        rows = []
        for word, df, copies in zip(*(b.column(c).to_pylist() for c in ("word", "df", "copies"))):
            if is_clean(word):
                weak: dict[str, list[str]] = {}
                strong = garbled_forms(word, weak)
                plain, letters = oddity(word), sum(c.isalpha() for c in word)
                rows += [(g, word, c, f, False, oddity(g) - plain, letters, df, copies) for g, (c, f) in strong.items()]
                rows += [(g, word, c, True, True, oddity(g) - plain, letters, df, copies) for g, chains in weak.items() for c in chains]
        cols = list(zip(*rows)) or [()] * 9
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in FORMS.split(", ")])


def document_words(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the text and the distinct words of its text with non-ASCII characters; by the JVM, over whole texts. Everything that is no letter and
    ASCII becomes a space and the text is split there: no pattern walks the text, so a run of any length is one word."""
    blank = F.translate(F.regexp_replace("text", INLINE_CODE, " "), _SEPARATORS, " " * len(_SEPARATORS))
    words = F.array_distinct(F.filter(F.split(blank, " "), lambda w: F.octet_length(w) > F.char_length(w)))
    return docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", F.xxhash64("text").alias("text_key"), words.alias("words"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, the number of distinct texts that have it, and of documents."""
    texts = words.groupBy("text_key").agg(F.any_value("words").alias("words"), F.count("*").alias("n"))
    counted = texts.select("n", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("copies"))
    return materialize(counted, "mojibake-vocabulary")


def matches(vocab: DataFrame) -> DataFrame:
    """The forms that are words of the corpus, own_df and own_copies: the texts and documents that have them."""
    seen = vocab.select(F.col("word").alias("garbled"), F.col("df").alias("own_df"), F.col("copies").alias("own_copies"))
    return materialize(spread(vocab).mapInArrow(_forms, FORMS).join(seen.hint("merge"), "garbled"), "mojibake-matches")


def _size(words: DataFrame) -> int:
    """Rows of a table of words for `lookup`, or what its bytes amount to in rows of 200."""
    rows, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("garbled") + F.coalesce(F.octet_length("original"), F.lit(0))), F.lit(0))).first()
    return max(rows, size // 200)


#: copies of a text decide only between words in equally many texts, and not for an original that looks less like a word
_SURE = "NOT short AND (NOT frequent OR df > own_df OR (df = own_df AND copies > own_copies AND odd >= 0))"


def verified_words(hits: DataFrame) -> DataFrame:
    """garbled, original (null where a lossy chain leaves several), chain of every garbled word of the corpus."""
    more = F.expr("df > own_df OR copies > own_copies")
    hits = hits.where(_SURE)
    # originals that are more frequent than the form, the most frequent, then the first by text
    best = F.max_by(F.struct("original", "chain"), F.struct(~F.col("frequent"), more, "df", "original"))
    hits = hits.groupBy("garbled").agg(best.alias("b"), F.coalesce(F.nullif(F.count_distinct(F.when(more, F.col("original"))), F.lit(0)), F.count_distinct("original")).alias("n"))
    lossy = F.col("garbled").contains("\ufffd") & (F.col("n") > 1)
    return hits.select("garbled", F.when(~lossy, F.col("b.original")).alias("original"), F.col("b.chain").alias("chain"))


def _by_chain(hits: DataFrame) -> DataFrame:
    """garbled, chain, original, letters, the most frequent original of each chain."""
    best = F.max_by(F.struct("original", "letters"), F.struct("df", "original"))
    return hits.groupBy("garbled", "chain").agg(best.alias("b")).select("garbled", "chain", "b.original", "b.letters")


def _together(pairs: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """Rows like found for words that prove nothing alone, but several of one chain in their document do."""
    likely = materialize(_by_chain(hits.where(f"odd > 0 AND df >= own_df AND letters >= 2 AND NOT ({_SURE})")), "mojibake-likely")
    maybe = lookup(pairs, likely, ["garbled"], _size(likely))
    proven = maybe.groupBy("doc_id", "chain").agg(F.count("*").alias("n"), F.sum("letters").alias("l")).where((F.col("n") >= TOGETHER) & (F.col("l") >= LETTERS))
    more = maybe.join(proven, ["doc_id", "chain"]).join(found.select("doc_id", "garbled"), ["doc_id", "garbled"], "left_anti")
    # the chain with the most words, then the first by name
    best = F.min_by(F.struct("original", "chain"), F.struct(-F.col("n"), "chain"))
    return more.groupBy("doc_id", "garbled").agg(best.alias("b")).select("doc_id", "garbled", "b.original", "b.chain")


def affected(docs: DataFrame, short_words: bool = False) -> DataFrame:
    """doc_id, garbled, original, chain of every garbled word of every affected document. short_words: also the words that are no
    proof (too short, or no rarer than their original), where another word of the same document proves their chain."""
    words = materialize(document_words(docs.select("doc_id", "text")), "mojibake-words")
    hits = matches(vocabulary(words))
    table = materialize(verified_words(hits), "mojibake-verified")
    pairs = words.select("doc_id", F.explode("words").alias("garbled"))
    found = lookup(pairs, table, ["garbled"], _size(table))
    found = materialize(found, "mojibake-found")
    found = found.unionByName(_together(pairs, hits, found))
    if not short_words:
        return found
    found = materialize(found, "mojibake-found")
    chains = found.select("doc_id", "chain").distinct()
    weak = _by_chain(hits.where(f"short OR (odd > 0 AND df >= own_df AND NOT ({_SURE}))"))
    rest = words.join(chains.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("words").alias("garbled")).join(found.select("doc_id", "garbled"), ["doc_id", "garbled"], "left_anti")
    more = rest.join(chains, "doc_id").join(weak, ["garbled", "chain"])
    more = more.groupBy("doc_id", "garbled").agg(F.min_by(F.struct("original", "chain"), "chain").alias("b")).select("doc_id", "garbled", "b.original", "b.chain")
    return found.unionByName(more)


def affected_ids(docs: DataFrame) -> DataFrame:
    return affected(docs).select("doc_id").distinct()


RESTORED = "doc_id bigint, garbled_words int, restored_words int, chains string, restored_text string"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for doc, text, pairs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "pairs"))):
            swap = {p["garbled"]: p["original"] for p in pairs if p["original"] is not None}
            fix = lambda t, swap=swap: WORD.sub(lambda m: swap.get(m[0], m[0]), t)
            out, at = [], 0
            for m in CODE.finditer(text):
                out += [fix(text[at : m.start()]), m[0]]
                at = m.end()
            out.append(fix(text[at:]))
            for c, x in zip(cols, (doc, len(pairs), len(swap), ",".join(sorted({p["chain"] for p in pairs})), "".join(out))):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "garbled_words", "restored_words", "chains", "restored_text"])


def restored(docs: DataFrame) -> DataFrame:
    """Affected documents with every garbled word of known original put right. restored_words < garbled_words: in part."""
    found = affected(docs, short_words=True).groupBy("doc_id").agg(F.collect_list(F.struct("garbled", "original", "chain")).alias("pairs"))
    found = materialize(found, "mojibake-pairs")
    # only the texts that are affected are shuffled
    ids = found.select("doc_id")
    texts = lookup(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), ids, ["doc_id"], ids.count())
    return texts.join(found, "doc_id").mapInArrow(_restore, RESTORED)
