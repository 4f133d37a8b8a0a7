"""Line-first cleaning: judge every line, drop the failing ones, reject texts that lose too much.

All of it is column expressions over one row; no shuffle and no Python on the executors.

A line that has a word fails if
 * punctuation: it has at least ``min_words`` words and doesn't end as a sentence does (after
   closing quotes and brackets), or more than ``max_shouts`` of its words end in two or more ``!?``;
 * navigation: it has at least ``min_words`` words and more than ``max_symbols`` symbols
   ``#*$%&|<>`` or menu signs a word, as link lists, separators and markup have; or it is shorter,
   doesn't end as a sentence does, and has a menu sign (``Home » News``, ``Next →``), is a word
   of navigation, or lies in a run of ``menu_lines`` or more such short lines, as menus do;
 * boilerplate: it has at most ``boilerplate_words`` words and one of ``BOILERPLATE``.
Lines without a word are no loss, and don't part a run.  A text is kept if it passes the base
rules (50 words, and at most half of its words in repeated three-word windows) and failing lines
hold at most ``max_lost`` of its word characters.

A null text has no words, so it fails the base rules; so do empty ones.  Very long texts are
read whole.  Repeated rows are judged alike, each for itself.  Ties: a text that loses just
``max_lost`` is kept.  An empty table gives an empty result.  Columns may have any names; those
that ``clean_lines`` adds replace columns of their names, and all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import SPACED_WORD, by_position, position

#: Phrases that mark page furniture, in English, German, French and Spanish.
BOILERPLATE = (
    "cookie", "cookies", "javascript", "all rights reserved", "subscribe to", "click here", "terms of use", "terms of service", "privacy policy", "sign in", "sign up", "log in", "skip to", "share this", "read more", "follow us", "powered by", "back to top",
    "alle rechte vorbehalten", "datenschutz", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "hier klicken", "weiterlesen", "mehr lesen", "anmelden", "abmelden", "newsletter abonnieren", "zum inhalt springen", "nach oben",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici", "lire la suite", "se connecter", "s'inscrire", "abonnez-vous", "aller au contenu", "haut de page",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "haga clic aquí", "haz clic aquí", "leer más", "iniciar sesión", "regístrate", "suscríbete", "saltar al contenido", "volver arriba",
)
#: Whole short lines that are navigation.
MENU = (
    "home", "about", "about us", "contact", "contact us", "news", "blog", "shop", "search", "menu", "login", "logout", "register", "help", "faq", "sitemap", "next", "previous", "next page", "previous page", "more", "share", "print", "top",
    "startseite", "über uns", "kontakt", "suche", "hilfe", "weiter", "zurück", "nächste seite", "vorherige seite", "mehr", "teilen", "drucken",
    "accueil", "à propos", "recherche", "aide", "suivant", "précédent", "page suivante", "page précédente", "plus", "partager", "imprimer",
    "inicio", "acerca de", "contacto", "buscar", "ayuda", "siguiente", "anterior", "página siguiente", "página anterior", "más", "compartir", "imprimir",
)
_BLANKS = " \t\n\x0b\x0c\r"
SIGNS = "[|»«›‹→←•·<>]"
ENDS = r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""


def _any_of(phrases: list[str]) -> str:
    """An expression for any of the phrases that tries each first letter once."""
    tails: dict[str, list[str]] = {}
    for p in phrases:
        tails.setdefault(p[:1], []).append(p[1:])
    if len(tails) == 1 and "" not in tails:
        first, rest = next(iter(tails.items()))
        return first + (_any_of(rest) if any(rest) else "")
    parts = [c + (_any_of(rest) if any(rest) else "") for c, rest in tails.items() if c]
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in tails else "")


FURNITURE = rf"(?:^|[^\p{{L}}\p{{N}}]){_any_of(list(BOILERPLATE))}(?:$|[^\p{{L}}\p{{N}}])"
MENU_LINE = rf"^[^\p{{L}}\p{{N}}]*{_any_of(list(MENU))}[^\p{{L}}\p{{N}}]*$"


def _repeats(df: DataFrame, words: str, prefix: str) -> DataFrame:
    """Add ``{prefix}n``: the words that lie in three-word windows found twice or more.

    Windows are hashed, sorted with their positions and compared with their neighbours; the
    positions found are sorted again and each covers up to three words.  Intermediate arrays
    are columns of their own, for lambdas would evaluate a captured expression for each element.
    """
    g, s, p = (f"{prefix}{x}" for x in "gsp")
    df = df.withColumn(g, F.expr(f"case when size({words}) >= 3 then transform(slice({words}, 1, size({words}) - 2), (x, i) -> xxhash64(x, get({words}, i + 1), get({words}, i + 2))) end"))
    df = df.withColumn(s, F.expr(f"case when size(array_distinct({g})) < size({g}) then sort_array(transform({g}, (h, i) -> struct(h as h, i as i))) end"))
    df = df.withColumn(p, F.expr(f"sort_array(filter(transform({s}, (x, i) -> case when x.h = get({s}, i - 1).h or x.h = get({s}, i + 1).h then x.i end), i -> i is not null))"))
    covered = f"aggregate(transform({p}, (x, i) -> least(3, coalesce(get({p}, i + 1), x + 3) - x)), 0L, (a, x) -> a + x)"
    return df.withColumn(f"{prefix}n", F.expr(f"coalesce({covered}, 0L)")).drop(g, s, p)


def line_facts(line: Column, min_words: int = 5, max_symbols: float = 0.3, max_shouts: float = 0.3, boilerplate_words: int = 12) -> Column:
    """struct<bad, open, chars>: whether a line fails for itself, whether it is a short one that doesn't end as a sentence does, its word characters."""
    chars = (F.length(line) - F.regexp_count(line, F.lit(r"[\x20\x09-\x0D]"))).cast("long")
    # A gap between words is white space after a character, so words are counted by what they are parted by.
    read = F.struct(F.size(F.split(F.trim(line, F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")).alias("n"), line.rlike(ENDS).alias("ends"), line.alias("line"), chars.alias("chars"))

    def judged(x: Column) -> Column:
        n = x["n"]
        symbols = F.regexp_count(x["line"], F.lit(r"[#*$%&|<>»«›‹→←•·]"))
        shouts = F.when(F.contains(x["line"], F.lit("!")) | F.contains(x["line"], F.lit("?")), F.regexp_count(x["line"], F.lit(r"[!?]{2,}(?![^\x20\x09-\x0D])"))).otherwise(0)
        long_ = (n >= min_words) & (~x["ends"] | (symbols > max_symbols * n) | (shouts > max_shouts * n))
        open_ = (n < min_words) & ~x["ends"]
        short = open_ & (x["line"].rlike(SIGNS) | F.lower(x["line"]).rlike(MENU_LINE))
        return F.struct((long_ | short | ((n <= boilerplate_words) & F.lower(x["line"]).rlike(FURNITURE))).alias("bad"), open_.alias("open"), x["chars"].alias("chars"))

    # Bound as the only element of an array, so that what is used twice is evaluated once.
    return F.get(F.transform(F.array(read), judged), F.lit(0))


def clean_lines(df: DataFrame, text_col: str = "text", max_lost: float = 0.5, min_words: int = 50, max_repeat: float = 0.5, menu_lines: int = 3, **line_rules) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed_lines, lost_chars, clean_text and kept."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed_lines", "lost_chars", "clean_text", "kept")
    stay = [k for k, c in enumerate(df.columns) if c.lower() not in added]
    docs, text = by_position(df), F.coalesce(F.col(position(df, text_col)), F.lit(""))
    docs = docs.withColumns({
        "_words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACED_WORD)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    })
    docs = _repeats(docs, "_words", "_rep_")
    docs = docs.withColumns({"n_words": F.size("_words").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_facts": F.transform("_lines", lambda x: line_facts(x, **line_rules))})
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    # In a run of so many short open lines: as many of them from some line up to this one on.
    near = lambda i, d: F.coalesce(F.get("_facts", i + d)["open"], F.lit(False))
    run = lambda i: F.array_max(F.array(*(F.least(*(near(i, d + k) for k in range(menu_lines)), F.lit(True)) for d in range(1 - menu_lines, 1))))
    docs = docs.withColumn("_bad", F.transform("_facts", lambda x, i: x["bad"] | (x["open"] & run(i))))
    docs = docs.withColumns({
        "n_repeat_words": F.col("_rep_n"),
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("_rep_n") > F.lit(round(100 * max_repeat)) * F.col("n_words")),
        "n_failed_lines": F.size(F.filter("_bad", lambda b: b)).cast("long"),
        "word_chars": total(F.transform("_facts", lambda x: x["chars"])),
        "lost_chars": total(F.transform("_facts", lambda x, i: F.when(F.get("_bad", i), x["chars"]).otherwise(0))),
        "clean_text": F.array_join(F.filter("_lines", lambda x, i: ~F.get("_bad", i)), "\n"),
    })
    docs = docs.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars")))
    return docs.select(*(F.col(f"_k{k}").alias(df.columns[k]) for k in stay), *added)
