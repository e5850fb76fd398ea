"""Quality rules, line first: lines that fail a rule go, and so do documents that lose
too much of their text with them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII white space, symbols, and lines that are no content of their own.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines, in lower case, as words set apart by single spaces.
BOILERPLATE = {
    "en": [
        "all rights reserved", "privacy policy", "terms of use", "terms of service", "terms and conditions", "cookie policy",
        "accept all cookies", "cookie settings", "we use cookies", "licensed under", "released under",
        "subscribe to our newsletter", "subscribe", "sign up", "sign in", "log in", "enable javascript", "lorem ipsum", "click here", "read more", "share this",
    ],
    "fr": [
        "tous droits réservés", "politique de confidentialité", "conditions d utilisation", "mentions légales", "sous licence",
        "accepter les cookies", "s abonner", "abonnez vous", "se connecter", "activer javascript", "cliquez ici", "lire la suite",
    ],
    "de": [
        "alle rechte vorbehalten", "datenschutz", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "lizenziert unter",
        "cookies akzeptieren", "jetzt abonnieren", "hier anmelden", "javascript aktivieren", "hier klicken", "weiterlesen",
    ],
    "es": [
        "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "bajo la licencia",
        "aceptar cookies", "suscríbete", "iniciar sesión", "activar javascript", "haga clic aquí", "leer más",
    ],
}
#: A line is boilerplate if phrases make up this share of its letters and digits. Longer
#: lines than these many characters are text, whatever they say.
PHRASE_SHARE, LONGEST_BOILERPLATE = 0.5, 200
#: Signs between the entries of menus and trails of links.
NAVIGATION = "|>»›·•"

#: A line is navigation from so many separators on, if they are this share of its words.
SEPARATORS, SEPARATOR_SHARE = 3, 0.25
#: A line has broken punctuation if it has so many signs a word, or is so long without any end.
SIGNS_PER_WORD, LONG_WITHOUT_END = 1.5, 60
#: A document is rejected if more than this share of its characters goes with the lines.
MOST_LOST = 0.5
LEAST_WORDS = 50


def _chars(text: str) -> str:
    """SQL: code points of `text` outside white space."""
    return f"char_length(translate({text}, '{_escaped(SPACE)}', ''))"


def _escaped(text: str) -> str:
    return "".join(f"\\u{ord(c):04X}" for c in text)


def phrase_pattern() -> str:
    """The phrases, longest first, in a text whose words have two spaces between them."""
    phrases = sorted((p for listed in BOILERPLATE.values() for p in listed), key=lambda p: (-len(p), p))
    return f" (?:{'|'.join(p.replace(' ', '  ') for p in phrases)}) "


def metrics(docs: DataFrame) -> DataFrame:
    """Every row of docs with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, n_lines, n_bad_lines, chars_lost (long), kept and
    cleaned (the text without the lines that fail). Columns of these names are replaced,
    others stay. A null text has no words or lines; a text without words fails. Each row
    is judged by itself, so repeated rows fare alike; texts of any length are judged whole;
    no rows give none.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "chars_lost", "kept", "cleaned"]
    rest = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), text.alias("t"))
    space = _escaped(SPACE)
    df = df.withColumn("trimmed", F.expr(f"trim(both '{space}' from t)"))
    df = df.withColumn("w", F.expr("if(trimmed = '', cast(array() as array<string>), split(trimmed, '[ \\\\x09-\\\\x0D]+', -1))")).drop("trimmed")
    df = df.withColumn("lines", F.expr(f"filter(split(t, '\\n', -1), l -> trim(both '{space}' from l) <> '')"))
    # three-word windows: hashes in the high bits, places in the low ones
    df = df.withColumn("bits", F.expr("cast(ceil(log2(size(w) + 2)) as int)"))
    windows = "transform(sequence(0, size(w) - 3), i -> shiftleft(shiftright(xxhash64(w[i], w[i + 1], w[i + 2]), bits), bits) | cast(i as bigint))"
    df = df.withColumn("h", F.expr(f"if(size(w) < 3, cast(array() as array<bigint>), sort_array({windows}))"))
    near = lambda k: f"shiftright(h[{k}], bits) = shiftright(x, bits)"
    again = f"filter(h, (x, k) -> (k > 0 and {near('k - 1')}) or (k < size(h) - 1 and {near('k + 1')}))"
    df = df.withColumn("near", F.expr(f"transform({again}, x -> cast(x & (shiftleft(1L, bits) - 1) as int))")).drop("h", "bits")
    # windows with equal hashes are compared as words
    said = "array_sort(transform(near, i -> named_struct('s', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i)))"
    df = df.withColumn("g", F.expr(f"if(size(near) = 0, cast(array() as array<struct<s:string,i:int>>), {said})")).drop("near")
    df = df.withColumn("p", F.expr("sort_array(transform(filter(g, (x, k) -> (k > 0 and g[k - 1].s = x.s) or (k < size(g) - 1 and g[k + 1].s = x.s)), x -> x.i))")).drop("g")
    repeat = "aggregate(p, named_struct('last', -3, 'n', 0), (acc, i) -> named_struct('last', i, 'n', acc.n + least(3, i - acc.last)), acc -> acc.n)"
    signs = f"(char_length(x.l) - char_length(translate(x.l, '{SYMBOLS}!', '')))"
    bars = f"(char_length(x.l) - char_length(translate(x.l, '{NAVIGATION}', '')))"
    gaps = "(1 + char_length(x.l) - char_length(translate(x.l, ' ', '')))"  # about the number of words
    said = f"regexp_extract_all(x.words, '{phrase_pattern()}', 0)"
    letters = lambda e: f"char_length(replace({e}, ' ', ''))"
    phrases = f"coalesce({letters(f'array_join({said}, {chr(39) * 2})')} >= {PHRASE_SHARE} * {letters('x.words')} and {letters('x.words')} > 0, false)"
    bad = f"""({phrases}
        or ({bars} >= {SEPARATORS} and {bars} >= {SEPARATOR_SHARE} * {gaps})
        or ({signs} >= {SIGNS_PER_WORD} * {gaps})
        or ({gaps} >= {LONG_WITHOUT_END} and not x.l rlike '[.!?,;:…。！？]'))"""
    # each word of a short line between two spaces, so that a phrase is one of whole words
    words = f"if(char_length(l) > {LONGEST_BOILERPLATE}, '', concat(' ', regexp_replace(lower(l), '[^\\\\p{{L}}\\\\p{{N}}]+', '  '), ' '))"
    df = df.withColumn("lowered", F.expr(f"transform(lines, l -> named_struct('l', l, 'words', {words}))"))
    df = df.withColumn("marks", F.expr(f"transform(lowered, x -> named_struct('l', x.l, 'n', {_chars('x.l')}, 'bad', {bad}))")).drop("lowered")
    long = lambda e: f"cast({e} as bigint)"
    df = df.select(
        "rest",
        F.expr(long("size(w)")).alias("n_words"),
        F.expr(long(_chars("t"))).alias("word_chars"),
        F.expr(long(f"char_length(t) - char_length(translate(t, '{SYMBOLS}', ''))")).alias("n_symbols"),
        F.expr(long("size(lines) - size(array_distinct(lines))")).alias("n_dup_lines"),
        F.expr(long(repeat)).alias("n_repeat_words"),
        F.expr(long("size(lines)")).alias("n_lines"),
        F.expr(long("size(filter(marks, x -> x.bad))")).alias("n_bad_lines"),
        F.expr(long("aggregate(marks, 0, (acc, x) -> acc + if(x.bad, x.n, 0))")).alias("chars_lost"),
        F.expr("array_join(transform(filter(marks, x -> not x.bad), x -> x.l), '\\n')").alias("cleaned"),
    )
    # a filter on a figure would otherwise be pushed down and work the formulas out again
    figures = F.explode(F.array(F.struct(*[c for c in df.columns if c != "rest"]))).alias("m")
    df = df.select("rest", figures).select("rest", "m.*")
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words")
    df = df.withColumn("base_failed", failed).withColumn("kept", F.expr(f"not base_failed and chars_lost <= {MOST_LOST} * word_chars"))
    return df.select("rest.*", *made) if rest else df.select(*made)


def report(docs: DataFrame) -> DataFrame:
    """doc_id and the figures and verdicts of metrics(), without the text."""
    found = metrics(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "chars_lost")
