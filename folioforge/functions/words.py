"""Word lists and mappings. Results depend on exactly these."""

from __future__ import annotations

STOP_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "or", "but", "not", "this", "these"),
    "de": ("der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "eines", "einem", "einen", "und", "oder", "aber", "von", "zu", "im", "am", "um", "bei", "mit", "für", "aus", "auf", "durch"),
    "fr": ("le", "la", "les", "un", "une", "des", "du", "de", "d", "et", "ou", "mais", "dans", "pour", "par", "sur", "avec", "au", "aux", "ce", "cette", "ces", "est", "sont", "être", "avoir", "à", "son", "sa"),
    "es": ("el", "la", "los", "las", "un", "una", "unos", "unas", "y", "o", "pero", "en", "por", "para", "con", "sin", "sobre", "del", "al", "es", "son", "ser", "estar", "haber", "ha", "han", "su", "sus"),
    "it": ("il", "lo", "la", "i", "gli", "le", "un", "uno", "una", "e", "o", "ma", "in", "di", "d", "da", "per", "con", "su", "del", "della", "dei", "degli", "delle", "al", "alla", "ai", "agli", "alle", "è", "sono"),
    "pt": ("o", "a", "os", "as", "um", "uma", "uns", "umas", "e", "ou", "mas", "em", "de", "por", "para", "com", "sem", "sobre", "do", "da", "dos", "das", "ao", "à", "aos", "às", "é", "são", "seu", "sua"),
    "nl": ("de", "het", "een", "en", "of", "maar", "in", "op", "voor", "van", "met", "door", "bij", "aan", "naar", "om", "over", "is", "zijn", "was", "waren", "heeft", "hebben", "had", "hadden", "der"),
    "la": ("et", "in", "ad", "cum", "ex", "ab", "a", "e", "de", "per", "pro", "sub", "atque", "sed", "aut", "vel", "ac", "neque", "nec", "est", "sunt"),
    "ru": ("и", "в", "на", "с", "по", "для", "к", "от", "за", "о", "из", "у", "это", "как", "но", "или", "а", "не", "что", "он"),
    "el": ("ο", "η", "το", "οι", "τα", "και", "ή", "αλλά", "σε", "από", "για", "με", "στο", "στη", "στον", "στην", "του", "της", "των", "εν"),
    "he": ("ה", "ו", "ב", "ל", "מ", "ש", "של", "את", "על", "אל", "עם", "כי", "אם", "או", "זה", "זאת", "אלה", "הוא", "היא"),
    "ar": ("في", "من", "إلى", "على", "هذا", "هذه", "و", "أو", "لا", "ما", "هو", "هي", "التي", "الذي", "مع", "عن", "إن", "ال"),
}
FRONT_MATTER = ("preface", "foreword", "acknowledgments", "acknowledgements", "table of contents", "contents", "toc", "dedication", "about the author", "about this book", "prologue", "copyright", "isbn", "title page", "half title", "frontispiece", "list of illustrations", "list of maps", "vorwort", "geleitwort", "danksagung", "inhaltsverzeichnis", "inhalt", "widmung", "über den autor", "prolog")
BACK_MATTER = ("index", "bibliography", "references", "glossary", "appendix", "notes", "endnotes", "epilogue", "afterword", "abbreviations", "about the publisher", "colophon", "register", "sachregister", "personenregister", "namenregister", "bibliographie", "literaturverzeichnis", "literatur", "quellenverzeichnis", "glossar", "anhang", "anmerkungen", "endnoten", "epilog", "nachwort", "abkürzungen", "abkürzungsverzeichnis")
TOC_MARKERS = ("table of contents", "contents", "chapter", "part", "section", "index", "appendix", "preface", "introduction", "bibliography", "inhaltsverzeichnis", "kapitel", "teil", "register", "anhang", "vorwort", "einleitung", "literaturverzeichnis")
#: Leading articles, in the order in which they are taken off.
ARTICLES = ("the ", "a ", "an ", "der ", "die ", "das ", "ein ", "eine ", "le ", "la ", "les ", "un ", "une ", "el ", "la ", "los ", "las ")
USER_MARKERS = ("user", "human", "nutzer", "ich")
SENTENCE_ENDS = ".!?;:'\"»)"


def stop_words(*languages: str) -> tuple[str, ...]:
    """Stop words of some languages; of all if none is known."""
    known = [x for x in languages if x in STOP_WORDS] or list(STOP_WORDS)
    return tuple(sorted({w for x in known for w in STOP_WORDS[x]}))
