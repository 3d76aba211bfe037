"""Filings into sentences: HTML and text, sections, paragraphs, sentences, and what is still to be fetched."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marlstone.functions.dates import temporal_bin
from marlstone.functions.text import pad_cik

# Section numbers by item.
SECTION_IDS = {"1": 0, "1A": 1, "1B": 2, "2": 3, "3": 4, "4": 5, "5": 6, "6": 7, "7": 8, "7A": 9, "8": 10, "9": 11, "9A": 12, "9B": 13, "10": 14, "11": 15, "12": 16, "13": 17, "14": 18, "15": 19}
# Damaged sequences and what they stood for.
MOJIBAKE = {"â€™": "’", "â€˜": "‘", "â€œ": "“", "â€\x9d": "”", "â€“": "–", "â€”": "—", "â€¦": "…", "Â\xa0": " ", "Â ": " ", "Ã©": "é", "Ã¨": "è", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "ï¿½": "�"}
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st inc corp co ltd llc l.p plc no nos vs v etc e.g i.e u.s u.k fig approx dept est jan feb mar apr jun jul aug sep sept oct nov dec vol pp cf al".split())
_ITEM = re.compile(r"^\s*item\s*(1[0-6]|1a|1b|7a|9a|9b|[1-9])\s*[.:\-–—)]?\s*(.*)$", re.I)


def normal_text(s: str | None) -> str:
    """NFKC form with damaged sequences repaired, controls dropped and spaces shortened; line breaks stay."""
    s = s or ""
    for bad, good in MOJIBAKE.items():
        s = s.replace(bad, good)
    s = unicodedata.normalize("NFKC", s).translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2013: "-", 0x2014: "-", 0x2212: "-"})
    s = "".join(c for c in s if c in "\n\t" or unicodedata.category(c)[0] != "C")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", s))).strip()


def strip_html(s: str | None) -> str:
    """The text of HTML: scripts, styles and tables that are mostly figures dropped, blocks on lines of their own."""
    s = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", s or "")

    def table(m: re.Match) -> str:
        t = re.sub(r"<[^>]+>", " ", m[0])
        w = t.split()
        figures = sum(any(c.isdigit() for c in x) for x in w)
        return " " if w and figures > 0.3 * len(w) and not re.search(r"(?i)\bitem\s+\d", t) else m[0]

    s = re.sub(r"(?is)<table\b.*?</table\s*>", table, s)
    s = re.sub(r"(?i)<\s*(?:br\s*/?|/\s*(?:p|div|tr|li|h[1-6]|ul|ol|table|section))\s*>", "\n\n", s)
    s = re.sub(r"(?i)<\s*/\s*t[hd]\s*>", " ", s)
    s = html.unescape(re.sub(r"<[^<>]+>", "", s))
    return normal_text(s)


def sections_of(text: str) -> list[tuple[str, str]]:
    """(item, text) between item headings; of an item met twice, as in a table of contents, the longer text counts."""
    found: dict[str, str] = {}
    item, lines = None, []

    def close() -> None:
        body = "\n".join(lines).strip()
        if item and len(body) > len(found.get(item, "")):
            found[item] = body

    for line in text.split("\n"):
        m = _ITEM.match(line)
        if m:
            close()
            item, lines = m[1].upper(), [m[2]] if len(m[2].split()) > 12 else []
        elif item:
            lines.append(line)
    close()
    return [(k, found[k]) for k in SECTION_IDS if found.get(k)]


def _is_heading(line: str) -> bool:
    w = line.split()
    return 0 < len(w) <= 12 and line[-1:] not in ".!?;:," and (line.isupper() or sum(x[:1].isupper() for x in w) >= 0.7 * len(w))


def split_sentences(p: str) -> list[str]:
    """Sentences of a paragraph; a full stop after an abbreviation, an initial or a number within text ends none."""
    out, start = [], 0
    for m in re.finditer(r"[.!?][\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9])", p):
        word = re.search(r"([\w.]+)[.!?][\"')\]]*$", p[start : m.end()].rstrip()[-24:])
        last = (word[1] if word else "").lower()
        if m[0][0] == "." and (last in ABBREVIATIONS or (len(last) == 1 and last.isalpha())):
            continue
        out.append(p[start : m.end()].strip())
        start = m.end()
    out.append(p[start:].strip())
    return [s for s in out if s]


def sentences_of(text: str, whole_under: int = 40) -> list[str]:
    """Sentences of a section: headings join the line below, paragraphs of fewer words stay whole."""
    paras, heads = [], []
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        if _is_heading(line):
            heads.append(line)
            continue
        paras.append(" ".join([*heads, line]))
        heads = []
    if heads:
        paras.append(" ".join(heads))
    out: list[str] = []
    for p in paras:
        out += [p] if len(p.split()) < whole_under else split_sentences(p)
    return [re.sub(r"\s+", " ", s).strip() for s in out if s.strip()]


SENTENCES = "doc_key string, section_item string, section_ID int, sentence_index int, sentence string"


def _split(it: Iterator[pd.DataFrame], is_html: bool, whole: bool) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for key, text in zip(pdf["doc_key"], pdf["text"]):
            plain = strip_html(text) if is_html else normal_text(text)
            parts = [("", plain)] if whole else sections_of(plain)
            rows += [(key, item, SECTION_IDS.get(item), i, s) for item, body in parts for i, s in enumerate(sentences_of(body))]
        yield pd.DataFrame(rows, columns=["doc_key", "section_item", "section_ID", "sentence_index", "sentence"]).astype({"section_ID": "Int32", "sentence_index": "int32"})


def split_documents(docs: DataFrame, key: str, text: str, is_html: bool = False, whole: bool = False) -> DataFrame:
    """(doc_key, section_item, section_ID, sentence_index, sentence) of each text; whole takes a text as one section.

    Null and blank texts give no rows; without item headings and without whole there are none either.
    """
    return docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("doc_key"), F.col(text).alias("text")).mapInPandas(lambda it: _split(it, is_html, whole), SENTENCES)


def staging(sentences: DataFrame, filings: DataFrame, form: str = "10-K", version: str = "v1", path: str = "", method: str = "ingest") -> DataFrame:
    """The staging rows of filings (doc_key, cik, name, period, filing_date, sic): ids, bins and audit columns added."""
    f = filings.withColumn("cik", pad_cik(F.col("cik"))).withColumn("report_year", F.substring("period", 1, 4).try_cast("int"))
    j = sentences.join(f, "doc_key").withColumn("docID", F.concat_ws("_", "cik", F.lit(form), F.col("report_year").cast("string")))
    return j.select(
        "cik", "name", "report_year", "docID", F.concat_ws("_", "docID", F.lit("section"), "section_item", F.col("sentence_index").cast("string")).alias("sentenceID"), F.concat(F.lit("ITEM_"), "section_item").alias("section_name"), "section_item", "section_ID",
        F.lit(form).alias("form"), "sentence_index", "sentence", F.col("sic").alias("SIC"), F.col("filing_date").alias("filingDate"), F.col("period").alias("reportDate"), temporal_bin(F.col("report_year")).alias("temporal_bin"), F.current_timestamp().alias("sample_created_at"),
        F.current_timestamp().alias("last_modified_date"), F.lit(version).alias("sample_version"), F.lit(path).alias("source_file_path"), F.lit(method).alias("load_method"),
    )


def item_columns(filings: DataFrame, key: str) -> DataFrame:
    """(key, section_key, text): the item_* columns of one-document JSON as rows."""
    cols = [c for c in filings.columns if c.startswith("item_")]
    return filings.unpivot([key], cols, "section_key", "text").where("text is not null and trim(text) <> ''")


def download_plan(index: DataFrame, have: DataFrame, keys: list[str], forms: list[str], ciks: DataFrame | None = None) -> DataFrame:
    """Index rows of the wanted forms and companies that are not fetched yet; keys of companies are compared as numbers."""
    out = index.where(F.col("form").isin(*forms)).withColumn("cik", F.col("cik").try_cast("long"))
    if ciks is not None:
        out = out.join(ciks.select(F.col("cik").try_cast("long").alias("cik")).distinct(), "cik", "left_semi")
    return out.join(have.select(*keys).distinct(), keys, "left_anti")
