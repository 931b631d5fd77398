"""Line-first cleaning of texts, and the base figures of whole texts.

Every line is judged alone: punctuation (a line of several words ends like a sentence, and has no
more symbols than words), navigation (bars, arrows, link words) and boilerplate (notices of sites, code).
Sentence marks are listed by script, words and phrases by language. Lines that fail are removed; a text that loses too much of its words, or fails the base rule, is rejected.

All of it is expressions inside the row: no shuffle, no Python. Repeated 8-word windows are found
from the windows' 64-bit hashes, combined from the words' hashes by doubling; only texts
with an equal pair are looked at further, by sorting.

Defined cases: a null or empty text has no words, fails the base rule and has a null or empty
cleaned text; a text of one very long line is one line; repeated rows give repeated results;
columns of the input that have the output's names are replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.llm.base import SPACES, WORD, free_names

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
# A text is rejected if its removed lines hold more than this share of its words.
MAX_LOST_PERCENT = 50
# A line of at least so many words should end in one of the marks.
SENTENCE_WORDS = 5
# Sentence marks by script, and signs that may follow one.
MARKS = {"Latin, Greek and Cyrillic": ".!?…:;,", "Arabic": "؟۔؛،", "Devanagari": "।॥", "Han and kana": "。！？：；，、", "Ethiopic": "።፧፨", "Armenian": "։", "Khmer": "។", "Burmese": "။", "Tibetan": "།"}
CLOSERS = "\"'”’»›)」』）】》"
END_SIGNS = "".join(MARKS.values()) + CLOSERS + "]"
END_MARKS = rf"[{END_SIGNS[:-1]}\]]\s*$"
# Whole lines of menus, of four words at most, and phrases of site notices, by language; other languages are an argument away.
NAVIGATION_LINES = {
    "en": "home|menu|next|previous|back|more|login|log in|sign in|sign up|register|search|contact|about|about us|skip to content|read more|share|print|page \\d+( of \\d+)?",
    "de": "startseite|weiter|anmelden|abmelden|registrieren|suche|kontakt|impressum|mehr lesen|weiterlesen|teilen|drucken|seite \\d+( von \\d+)?",
    "fr": "accueil|suivant|retour|connexion|inscription|recherche|contactez-nous|lire la suite|partager|imprimer|page \\d+ sur \\d+",
    "es": "inicio|siguiente|anterior|volver|iniciar sesi[oó]n|registrarse|buscar|contacto|leer m[aá]s|compartir|imprimir|p[aá]gina \\d+( de \\d+)?",
}
MENU_WORDS = 4
NOTICES = {
    "en": ["javascript", "cookies? (policy|settings|consent)", "uses? cookies", "privacy policy", "terms (of use|of service|and conditions)", "all rights reserved", "lorem ipsum", "subscribe to our", "click here", "powered by"],
    "de": ["verwenden cookies", "verwendet cookies", "nutzen cookies", "nutzt cookies", "cookie-einstellungen", "datenschutzerkl[aä]rung", "alle rechte vorbehalten", "newsletter abonnieren"],
    "fr": ["utilise des cookies", "politique de confidentialit[eé]s?", "tous droits r[eé]serv[eé]s", "mentions l[eé]gales"],
    "es": ["utiliza cookies", "usa cookies", "pol[ií]tica de (privacidad|cookies)", "todos los derechos reservados", "aviso legal"],
}


def any_of(phrases: list[str]) -> str:
    """A pattern of phrases, which tries those of one first letter only behind that letter."""
    letters: dict[str, list[str]] = {}
    for p in sorted(phrases):
        letters.setdefault(p[0], []).append(p[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in letters.items())


# Braces beside other signs of code.
CODE = r"[)=>]\s*\{|\{[^{}]*[;=][^{}]*\}|^\s*[{}]|\{\s*$"
BARS = r"( [|»›>•·] .*){2}"
MENU_LINE = rf"(?i)^\s*({'|'.join(NAVIGATION_LINES.values())})\s*$"
NOTICE = rf"(?i)\b(?:{any_of([p for of_lang in NOTICES.values() for p in of_lang])})"
# The same rules as one pattern each.
NAVIGATION = rf"{MENU_LINE}|{BARS}"
BOILERPLATE = rf"{NOTICE}|{CODE}"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    parts = F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(parts)


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def without(text: Column, characters: str) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), characters, "")


def n_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), has_word)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def doubled(hashes: Column, width: int, hash_: Callable[..., Column]) -> Column:
    """Hashes of ``width`` (a power of two) neighbours, from hashes of single items."""
    step = 1
    while step < width:

        def pair(h: Column, step: int = step) -> Column:
            ahead = F.slice(h, F.lit(step + 1), F.greatest(F.size(h) - step, F.lit(0)))
            here = F.slice(h, F.lit(1), F.greatest(F.size(h) - step, F.lit(0)))
            return F.zip_with(here, ahead, lambda a, b: hash_(a, b))

        hashes = let(hashes, pair)
        step *= 2
    return hashes


def covered_words(places: Column, width: int) -> Column:
    """Items covered by windows that start at the given sorted places."""
    ahead = F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0)))
    gaps = F.transform(F.arrays_zip(ahead.alias("b"), F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))).alias("a")), lambda p: F.least(p["b"] - p["a"], F.lit(width)))
    return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda n, g: n + g) + width)


def n_repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside ``width``-word windows that occur twice or more."""

    def marked(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def neighbours(s: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(F.transform(s, lambda x: x["h"]), F.lit(1), F.size(s) - 1))
            after = F.concat(F.slice(F.transform(s, lambda x: x["h"]), F.lit(2), F.size(s) - 1), F.array(F.lit(None).cast("bigint")))
            rows = F.arrays_zip(s.alias("s"), before.alias("before"), after.alias("after"))
            twice = F.filter(rows, lambda r: F.coalesce(r["s"]["h"] == r["before"], F.lit(False)) | F.coalesce(r["s"]["h"] == r["after"], F.lit(False)))
            return F.array_sort(F.transform(twice, lambda r: r["s"]["i"]))

        return let(let(F.array_sort(placed), neighbours), lambda p: covered_words(p, width))

    def of(hashes: Column) -> Column:
        any_twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(any_twice, marked(hashes)).otherwise(F.lit(0))

    first = F.transform(words, lambda w: F.xxhash64(w))
    found = let(doubled(first, width, lambda a, b: F.xxhash64(a, b)), of)
    return F.when(F.size(words) < width, F.lit(0)).otherwise(found).cast("bigint")


def line_fails(line: Column) -> Column:
    """Does the line break a rule? Lines without a word break none."""
    ends = F.contains(F.lit(END_SIGNS), F.substring(F.rtrim(line, F.lit(SPACES)), -1, 1))
    words = F.regexp_count(line, F.lit(WORD))
    unlike_text = ((words >= SENTENCE_WORDS) & ~ends) | (F.length(line) - F.length(without(line, SYMBOLS)) > words)
    # cheap tests first: they are true wherever the pattern behind them can match
    menu = ((words <= MENU_WORDS) & F.rlike(line, F.lit(MENU_LINE))) | F.rlike(line, F.lit(BARS))
    braces = F.contains(line, F.lit("{")) | F.contains(line, F.lit("}"))
    notice = F.rlike(line, F.lit(NOTICE)) | (braces & F.rlike(line, F.lit(CODE)))
    return has_word(line) & (unlike_text | menu | notice)


def cleaned(text: Column) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line_fails(line)), "\n")


def clean(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """``docs`` with cleaned_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, lost_words and kept."""
    t = F.col(text)
    (held,) = free_names(docs, "words")
    words = docs.withColumn(held, words_of(t))
    figures = words.withColumns(
        {
            "cleaned_text": cleaned(t),
            "n_words": F.size(held).cast("bigint"),
            "word_chars": F.length(without(t, SPACES)).cast("bigint"),
            "n_symbols": (F.length(F.coalesce(t, F.lit(""))) - F.length(without(t, SYMBOLS))).cast("bigint"),
            "n_dup_lines": n_duplicate_lines(t),
            "n_repeat_words": let(F.col(held), n_repeat_words),
        }
    )
    left = F.coalesce(F.regexp_count("cleaned_text", F.lit(WORD)), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = figures.withColumn("lost_words", F.col("n_words") - left).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * F.col("lost_words") <= max_lost * F.col("n_words"))
    return out.withColumn("kept", kept).drop(held)
