"""What users are told, by language, and the codes of languages. The wording of the keys is free; codes are fixed values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK = "en"
MESSAGES: dict[str, dict[str, str]] = {
    "en": {
        "no_results": "Nothing was found for '{query}'.", "source": "Source: {title}, p. {page}", "page_inferred": "page inferred", "books": "{n} books", "annotation": "Annotation", "comment": "Comment",
        "chunks": "{n} passages", "found": "{n} results for '{query}'", "searching": "Searching {n} passages", "search_failed": "The search failed: {error}", "no_text_index": "There is no text index, so words can't be searched for.", "use_vectors": "Search by meaning instead, or build the index.",
        "mode_hybrid": "Words and meaning", "mode_semantic": "Meaning", "mode_keyword": "Words", "exact_phrase": "Exact phrase", "language": "Language", "tags": "Tags", "all_tags": "All tags", "book": "Book", "all_books": "All books", "section": "Section", "chunk_type": "Kind of text", "format": "Format",
        "average": "Passages for each book", "export": "Export", "try_other": "Try other words, or fewer filters.", "index_old": "The index is older than {n} changes.", "orphans_refused": "{n} of {total} books would be deleted, which is too many.", "failed_books": "{n} books failed", "left_books": "{n} books are left",
    },
    "de": {
        "no_results": "Zu '{query}' wurde nichts gefunden.", "source": "Quelle: {title}, S. {page}", "page_inferred": "Seite erschlossen", "books": "{n} Bücher", "annotation": "Anmerkung", "comment": "Kommentar",
        "chunks": "{n} Stellen", "found": "{n} Treffer zu '{query}'", "searching": "{n} Stellen werden durchsucht", "search_failed": "Die Suche ist gescheitert: {error}", "no_text_index": "Ohne Textindex kann nicht nach Wörtern gesucht werden.", "use_vectors": "Suchen Sie nach der Bedeutung, oder bauen Sie den Index.",
        "mode_hybrid": "Wörter und Bedeutung", "mode_semantic": "Bedeutung", "mode_keyword": "Wörter", "exact_phrase": "Genauer Wortlaut", "language": "Sprache", "tags": "Schlagwörter", "all_tags": "Alle Schlagwörter", "book": "Buch", "all_books": "Alle Bücher", "section": "Abschnitt", "chunk_type": "Art des Texts", "format": "Format",
        "average": "Stellen je Buch", "export": "Ausgeben", "try_other": "Versuchen Sie andere Wörter oder weniger Filter.", "index_old": "Dem Index fehlen {n} Änderungen.", "orphans_refused": "{n} von {total} Büchern würden gelöscht, das sind zu viele.", "failed_books": "{n} Bücher sind gescheitert", "left_books": "{n} Bücher sind noch zu tun",
    },
    "fr": {"no_results": "Rien n'a été trouvé pour « {query} ».", "source": "Source : {title}, p. {page}", "books": "{n} livres", "found": "{n} résultats pour « {query} »", "language": "Langue", "book": "Livre", "export": "Exporter"},
}
# Language code to the code that text recognition uses.
OCR_CODES: dict[str, str] = {
    "en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita",
    "pt": "por", "nl": "nld", "la": "lat", "ru": "rus", "el": "ell",
    "he": "heb", "ar": "ara", "zh": "chi_sim", "ja": "jpn", "ko": "kor",
}


def locale_of(tag: str | None, known: Mapping[str, object] = MESSAGES) -> str:
    """The language of a tag such as de_AT.UTF-8, if it is known, else the fallback."""
    lang = (tag or "").replace("-", "_").partition("_")[0].partition(".")[0].lower()
    return lang if lang in known else FALLBACK


def say(key: str, lang: str | None = None, **values: object) -> str:
    """A message in a language; in the fallback where that lacks it, and the key itself where nobody has it."""
    said = MESSAGES[locale_of(lang)].get(key) or MESSAGES[FALLBACK].get(key, key)
    try:
        return said.format(**values)
    except (KeyError, IndexError):
        return said


def ocr_codes(languages: str) -> str:
    """Codes for text recognition of languages listed with commas, each once; English if none is known."""
    found = dict.fromkeys(OCR_CODES[x] for x in (p.strip().lower() for p in languages.split(",")) if x in OCR_CODES)
    return "+".join(found) or OCR_CODES[FALLBACK]


def said(key: str, lang: Column) -> Column:
    """The message for a column of languages, without values."""
    own = {k: m[key] for k, m in MESSAGES.items() if key in m}
    out = F.lit(own.get(FALLBACK, key))
    for k, m in own.items():
        out = F.when(lang == k, m).otherwise(out)
    return out


def ocr_code(lang: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in OCR_CODES.items() for x in kv])
    return F.coalesce(codes[F.lower(lang)], F.lit(OCR_CODES[FALLBACK]))
