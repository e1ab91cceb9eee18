"""Quality rules, line first: lines that fail a rule go, then documents that lost too much.

Each line is judged by itself for punctuation, navigation and boilerplate. A
document is kept if its base figures hold and the failing lines have at most
``max_loss`` of its word characters. One pass over Arrow batches; no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlens.llm.work import id_value, rows_of

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Phrases of page furniture by language; a short line that holds one is boilerplate.
FURNITURE = {
    "en": r"all rights reserved|cookie (?:policy|settings|preferences)|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|terms and conditions|"
    r"subscribe to our|sign up for|newsletter|click here|read more|share (?:this|on)|follow us|back to top|skip to (?:main )?content|log ?in|sign ?in|"
    r"powered by|javascript (?:is )?(?:required|disabled)|enable javascript|copyright (?:\(c\)|©|\d{4})|©\s*\d{4}|add to cart|leave a comment|related (?:posts|articles)",
    "de": r"alle rechte vorbehalten|cookie-?(?:richtlinie|einstellungen)|(?:alle )?cookies (?:akzeptieren|zulassen)|datenschutzerklärung|impressum|allgemeine geschäftsbedingungen|"
    r"nutzungsbedingungen|hier klicken|mehr lesen|weiterlesen|jetzt (?:anmelden|registrieren|abonnieren)|folgen sie uns|nach oben|zum inhalt springen|in den warenkorb|kommentar (?:hinterlassen|schreiben)|ähnliche beiträge",
    "fr": r"tous droits réservés|politique (?:de confidentialité|relative aux cookies)|(?:accepter|gérer) (?:tous )?les cookies|mentions légales|conditions (?:générales|d['’]utilisation)|"
    r"cliquez ici|lire la suite|en savoir plus|s['’]abonner|abonnez-vous|inscrivez-vous|suivez-nous|haut de page|aller au contenu|ajouter au panier|laisser un commentaire|articles (?:similaires|connexes)",
    "es": r"todos los derechos reservados|política de (?:privacidad|cookies)|aceptar (?:todas )?las cookies|aviso legal|términos y condiciones|condiciones de uso|"
    r"haga clic aquí|haz clic aquí|leer más|seguir leyendo|suscríbase|suscríbete|regístrate|síguenos|volver arriba|saltar al contenido|añadir al carrito|deja un comentario|(?:entradas|artículos) relacionad[oa]s",
}
#: A line that breaks off, as teasers do; also only where the line is short.
BROKEN_OFF = r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"
BOILERPLATE = re.compile("|".join([*FURNITURE.values(), BROKEN_OFF]), re.IGNORECASE)


@dataclass(frozen=True)
class Rules:
    """Limits of the line and document rules."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    #: Symbols a word that a line may have.
    max_symbols_per_word: float = 0.5
    #: Share of words that may carry repeated exclamation marks.
    max_shout_share: float = 0.33
    #: Bars a word that a line may have before it counts as navigation.
    max_bars_per_word: float = 0.25
    max_boilerplate_words: int = 12
    #: Share of neighbouring words that may be equal.
    max_stutter_share: float = 0.5
    #: Share of word characters that may go with failing lines.
    max_loss: float = 0.3


def line_failure(line: str, rules: Rules = Rules()) -> str | None:
    """The rule a line fails: punctuation, navigation, boilerplate or None. A blank line passes."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    bars = line.count("|") + line.count(" > ") + line.count("»")
    if bars >= 2 and bars > rules.max_bars_per_word * n:
        return "navigation"
    symbols = sum(line.count(c) for c in "#*$%&<>|")
    if symbols >= 3 and symbols > rules.max_symbols_per_word * n:
        return "punctuation"
    shouts = line.count("!!") + line.count("??")
    if shouts >= 2 and shouts > rules.max_shout_share * n:
        return "punctuation"
    if n <= rules.max_boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 6 and sum(a == b for a, b in zip(words, words[1:], strict=False)) > rules.max_stutter_share * n:
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a ``width``-word window found at least twice in the text."""
    n = len(words)
    if n <= width:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    key, span = ids[: n - width + 1], len(index)
    for j in range(1, width):
        if int(key.max()) + 1 > (2**62) // max(span, 1):  # renumber before the product overflows
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * span + ids[j : n - width + 1 + j]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(key, np.unique(twice)))
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return int((np.cumsum(step[:n]) > 0).sum())


def judge(body: bytes, rules: Rules = Rules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""
    text, words = body.decode("utf-8", "replace"), body.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(body.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = text.split("\n")
    filled = [x for x in lines if x.strip(WHITE)]
    dup = len(filled) - len(set(filled))
    repeats = repeated_words(words)
    failed = n < rules.min_words or repeats > rules.max_repeat_share * n
    good = [x for x in lines if line_failure(x, rules) is None]
    lost = chars
    if len(good) < len(lines):
        cleaned = "\n".join(good)
        lost = chars - (len(cleaned) - sum(cleaned.count(c) for c in WHITE))
    else:
        cleaned, lost = text, 0
    kept = not failed and lost <= rules.max_loss * chars
    return n, chars, symbols, dup, repeats, failed, kept, cleaned


OUT = "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, cleaned string"


def _judged(rules: Rules, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t.as_py(), rules) for t in b.column(1)]
            cols = list(zip(*got, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            arrays = [pa.array(c, k) for c, k in zip(cols[:7], kinds, strict=True)]
            arrays.append(pa.array(cols[7] if texts else [None] * len(got), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, *b.columns[2:]], [x.split()[0] for x in OUT.split(", ")] + b.schema.names[2:])

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: base figures, ``base_failed``, ``kept`` and the ``cleaned`` text.

    A null text counts as empty: no words, so it fails. Null ids stay null;
    repeated rows are judged each by itself; an empty table gives no rows. Texts
    of any length are judged whole. Other columns are ignored. With ``texts``
    off, ``cleaned`` is null, which saves moving it.
    """
    out = rows_of(docs, id_col, text_col).mapInArrow(_judged(rules, texts), OUT)
    return out.withColumn("doc_id", id_value(F.col("key"))).select("doc_id", *[x.split()[0] for x in OUT.split(", ")[1:]])


def clean_documents(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the columns it has: kept documents only, failing lines removed from their texts.

    A null text counts as empty and its row goes; repeated rows are judged each
    by itself; an empty table gives no rows. Other columns are carried along,
    whatever their names and nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text_col)
            got = [judge((t.as_py() or "").encode(), rules) for t in b.column(i)]
            stay = pa.array([g[6] for g in got], pa.bool_())
            text = pa.array([g[7] for g in got], pa.string())
            cols = [text if j == i else c for j, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(stay)

    return docs.mapInArrow(run, docs.schema)
