"""Line-first cleaning: lines are judged and removed first, then documents that lost too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import small_batches
from tessera.llm.textkit import shingles, text_buffer, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SEPARATORS = re.compile(r"(?:^|\s)[|»›•·→>/](?=\s|$)")
# Phrases of page furniture by language. Of FURNITURE one is enough in a short line; of HINTS, words that prose
# also has, only if they are a third of its words.
FURNITURE = {
    "en": ("all rights reserved", "privacy policy", "cookie policy", "cookie settings", "accept cookies", "accept all cookies", "uses cookies", "use cookies", "terms of use", "terms of service", "click here", "enable javascript", "powered by", "back to top", "skip to content"),
    "de": ("alle rechte vorbehalten", "cookies akzeptieren", "verwendet cookies", "verwenden cookies", "hier klicken", "klicken sie hier", "nach oben", "zum inhalt springen", "allgemeine geschäftsbedingungen"),
    "fr": ("tous droits réservés", "politique de confidentialité", "accepter les cookies", "utilise des cookies", "mentions légales", "conditions d'utilisation", "cliquez ici", "haut de page", "aller au contenu"),
    "es": ("todos los derechos reservados", "política de privacidad", "política de cookies", "aceptar cookies", "utiliza cookies", "aviso legal", "términos de uso", "condiciones de uso", "haga clic aquí", "haz clic aquí", "volver arriba", "saltar al contenido"),
    "it": ("tutti i diritti riservati", "informativa sulla privacy", "accetta i cookie", "utilizza i cookie", "termini di servizio", "clicca qui", "torna su"),
    "pt": ("todos os direitos reservados", "política de privacidade", "aceitar cookies", "termos de uso", "clique aqui", "voltar ao topo"),
    "nl": ("alle rechten voorbehouden", "klik hier", "algemene voorwaarden"),
    "": ("lorem ipsum",),
}
HINTS = {
    "en": ("subscribe", "sign in", "sign up", "log in", "login", "newsletter", "read more", "share this"),
    "de": ("datenschutzerklärung", "nutzungsbedingungen", "impressum", "anmelden", "abonnieren", "mehr lesen", "weiterlesen"),
    "fr": ("s'abonner", "se connecter", "s'inscrire", "lire la suite"),
    "es": ("suscribirse", "iniciar sesión", "registrarse", "leer más"),
    "it": ("iscriviti", "accedi", "leggi tutto"),
    "pt": ("assinar", "iniciar sessão", "leia mais"),
    "nl": ("privacyverklaring", "inloggen", "aanmelden", "lees meer"),
}


def _phrases(table: dict[str, tuple[str, ...]]) -> re.Pattern:
    every = sorted({p for own in table.values() for p in own}, key=lambda p: (-len(p), p))
    return re.compile(r"(?<!\w)(?:" + "|".join(re.escape(p).replace(r"\ ", r"\s+").replace("'", "['’]") for p in every) + r")(?!\w)", re.IGNORECASE)


_FURNITURE, _HINTS = _phrases(FURNITURE), _phrases(HINTS)
_MARKUP = re.compile(r"[#*$%&|<>{}\[\]=~^\\]")
_ENDS = tuple(".!?…:;\"”»)]。！？")

_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def line_fault(line: str) -> str | None:
    """The rule that a line with words fails: navigation, markup, shouting, repetition, boilerplate or punctuation; else None."""
    words = WORD.findall(line)
    n = len(words)
    if len(_SEPARATORS.findall(line)) * 5 >= n and n > 1:
        return "navigation"
    if len(_MARKUP.findall(line)) * 2 >= n and n > 1:
        return "markup"
    marks = line.count("!") + line.count("?")
    if marks >= 4 and marks * 2 >= n:
        return "shouting"
    if n >= 4 and sum(c.isupper() for c in line) * 5 > 4 * sum(c.isalpha() for c in line) > 0:
        return "shouting"
    if n >= 8 and len(set(words)) * 4 <= n:
        return "repetition"
    if n <= 15 and (_FURNITURE.search(line) or 3 * sum(len(h.split()) for h in _HINTS.findall(line)) >= n > 0):
        return "boilerplate"
    if n <= 3 and not line.rstrip().endswith(_ENDS):
        return "punctuation"
    return None


def clean_lines(text: str) -> tuple[str, int, int, int]:
    """The text without failed and repeated lines, lines removed, words kept, and lines equal to an earlier line."""
    seen: set[str] = set()
    kept, removed, words, again = [], 0, 0, 0
    for line in text.split("\n"):
        n = len(WORD.findall(line))
        if not n:
            kept.append(line)
            continue
        repeated = line in seen
        seen.add(line)
        again += repeated
        if repeated or line_fault(line):
            removed += 1
        else:
            kept.append(line)
            words += n
    return "\n".join(kept) if removed else text, removed, words, again


def repeated_words(words: np.ndarray, width: int = 3) -> int:
    """Words inside windows of width words that the text holds twice or more, the first included."""
    if len(words) < width + 1:
        return 0
    _, of, times = np.unique(shingles(words, width), return_inverse=True, return_counts=True)
    twice = times[of] > 1
    covered = np.zeros(len(words), bool)
    for j in range(width):
        covered[j : j + len(twice)] |= twice
    return int(covered.sum())


def line_first(docs: DataFrame, *, max_lost: float = 0.5, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Per row: doc_id, the columns in keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, words_kept, base_failed, kept, clean_text.

    base_failed: fewer than min_words words, or over half of the words lie in 3-word windows found twice. kept: not
    base_failed, and the lines left hold at least 1 - max_lost of the words. A null text has no words and fails. Rows with
    one id are judged apart, null ids too. One narrow pass: no shuffle, memory bounded by a batch and one text.
    """
    small_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "words_kept"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            raw, at = text_buffer(texts)
            rows, clean = [], []
            for k, (text, words) in enumerate(zip(texts.to_pylist(), word_hashes(texts, lower=False), strict=True)):
                own = raw[at[k] : at[k + 1]]
                cleaned, removed, left, again = clean_lines(text or "")
                rows.append((len(words), np.count_nonzero(_IN_WORD[own]), np.count_nonzero(_SYMBOL[own]), again, repeated_words(words), removed, left))
                clean.append(None if text is None else cleaned)
            table = np.array(rows, np.int64).reshape(-1, len(names))
            arrays = [*batch.columns[:-1], *(pa.array(table[:, j]) for j in range(len(names)))]
            fields = [*batch.schema.names[:-1], *names]
            if with_text:
                arrays.append(pa.array(clean, pa.string()))
                fields.append("clean_text")
            yield pa.RecordBatch.from_arrays(arrays, names=fields)

    carried = [F.col(c).alias(f"k{j}") for j, c in enumerate((id_col, *keep))]
    source = docs.select(*carried, F.col(text_col).alias("text"))
    kinds = ", ".join(f"k{j} {source.schema[f'k{j}'].dataType.simpleString()}" for j in range(len(carried)))
    out = source.mapInArrow(judge, f"{kinds}, " + ", ".join(f"{n} long" for n in names) + ", clean_text string" * with_text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("words_kept") >= (1 - max_lost) * F.col("n_words")))
    return out.withColumnsRenamed({f"k{j}": c for j, c in enumerate((id_col, *keep))})
