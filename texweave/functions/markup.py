"""A typed lexer for markup, as one ordered alternation and a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Environments whose name is one token.
ENVIRONMENTS = """equation equation* align align* aligned alignat alignat* gather gather* gathered multline multline* split
flalign flalign* matrix pmatrix bmatrix Bmatrix vmatrix Vmatrix smallmatrix array tabular cases rcases dcases subequations
math displaymath document figure table center flushleft flushright itemize enumerate description theorem proof lemma
corollary abstract""".split()
# The names of token types.
SYMBOLS = {
    "{": "LBRACE", "}": "RBRACE", "(": "LPAREN", ")": "RPAREN", "[": "LBRACKET", "]": "RBRACKET", "|": "PIPE", "^": "CARET",
    "_": "UNDERSCORE", "~": "TILDE", "&": "AMPERSAND", "#": "HASH", "=": "EQUALS", "+": "PLUS", "-": "MINUS", "*": "STAR",
    "/": "SLASH", "<": "LT", ">": "GT",
}
MERGEABLE = ("LETTER", "GREEK_UC", "GREEK_LC", "OTHER")


def _environment_pattern(names: list[str]) -> str:
    body = "|".join(sorted((n.replace("*", r"\*") for n in names), key=len, reverse=True))
    # White space may stand before the brace and on both sides of the name; Java looks behind over bounded runs.
    return rf"(?<=\\(?:begin|end)\s{{0,64}}\{{\s{{0,64}})(?:{body})(?=\s*\}})"


def pattern(names: list[str] = ENVIRONMENTS) -> str:
    return _environment_pattern(names) + r"|\\[a-zA-Z]+\*?|\\[^a-zA-Z\s]|\d+\.?\d*|\.\d+|\s+|\S"


def lexed(text: Column, names: list[str] = ENVIRONMENTS) -> Column:
    """Tokens in order as an array of strings; runs of white space become one space."""
    raw = F.regexp_extract_all(text, F.lit("(?U)" + pattern(names)), F.lit(0))
    return F.transform(raw, lambda t: F.when(F.rlike(t, F.lit(r"(?U)^\s+$")), F.lit(" ")).otherwise(t))


def token_type(token: Column, named: Column) -> Column:
    """The type of a token; ``named`` says whether it stands where an environment's name does."""
    kind = F.when(token == "\\\\", "LINEBREAK").when(F.rlike(token, F.lit(r"^\\[a-zA-Z]")), "COMMAND").when(F.startswith(token, F.lit("\\")) & (F.length(token) > 1), "ESCAPED")
    for symbol, name in SYMBOLS.items():
        kind = kind.when(token == symbol, name)
    return (
        F.when(named, "ENV_NAME").otherwise(
            kind.when(F.rlike(token, F.lit(r"(?U)^(?:\d|\.\d)")), "NUMBER").when(F.rlike(token, F.lit("^[\u0391-\u03a9]$")), "GREEK_UC")
            .when(F.rlike(token, F.lit("^[\u03b1-\u03c9]$")), "GREEK_LC").when(F.rlike(token, F.lit("^[a-zA-Z]$")), "LETTER")
            .when(token == " ", "SPACE").otherwise("OTHER")
        )
    )


def typed(text: Column, names: list[str] = ENVIRONMENTS) -> Column:
    """Tokens in order as an array of structs of token, ttype and frozen."""

    def of(tokens: Column) -> Column:
        def one(token: Column, at: Column) -> Column:
            back = lambda k: F.when(at >= k, F.get(tokens, at - k))
            # A command, a brace and the name; single spaces may stand before the brace and the name.
            before = F.when(back(1) == "{", F.when(back(2) == " ", back(3)).otherwise(back(2)))
            before = F.when((back(1) == " ") & (back(2) == "{"), F.when(back(3) == " ", back(4)).otherwise(back(3))).otherwise(before)
            named = token.isin(names) & F.coalesce(before.isin("\\begin", "\\end"), F.lit(False))
            kind = token_type(token, named)
            return F.struct(token.alias("token"), kind.alias("ttype"), (~kind.isin(*MERGEABLE)).alias("frozen"))

        return F.transform(tokens, one)

    return F.transform(F.array(lexed(text, names)), of)[0]  # lexed once a text


def token_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, token, ttype and frozen: one row a token."""
    # Of a column Spark would ask first whether it is empty, and so lex once more, in the scan and before rows are spread.
    each = rows.select(key, F.posexplode(typed(F.col(text))).alias("pos", "t"))
    return each.select(key, "pos", "t.token", "t.ttype", "t.frozen")


def zone_arrays(tokens: Column) -> Column:
    """Maximal runs of tokens that merges may join, as structs of start and units, from typed tokens."""

    def between(x: Column) -> Column:
        """x: the typed tokens and the places of the frozen ones, with one before the first and one after the last."""
        n = F.size(x["at"]) - 1
        run = lambda k: F.struct((F.get(x["at"], k) + 1).alias("start"), F.slice(x["t"], F.get(x["at"], k) + 2, F.get(x["at"], k + 1) - F.get(x["at"], k) - 1).alias("u"))
        runs = F.filter(F.transform(F.sequence(F.lit(0), n - 1), run), lambda r: F.size(r["u"]) > 0)
        return F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.transform(r["u"], lambda t: t["token"]).alias("units")))

    places = F.filter(F.transform(tokens, lambda t, i: F.when(t["frozen"], i)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(-1)), places, F.array(F.size(tokens)))
    return F.transform(F.array(F.struct(tokens.alias("t"), bounds.alias("at"))), between)[0]


def zone_texts(tokens: Column) -> Column:
    """The units of every zone of typed tokens, joined by spaces, as an array: units hold no white space."""
    marked = F.array_join(F.transform(tokens, lambda t: F.when(t["frozen"], F.lit("\n")).otherwise(t["token"])), " ")
    return F.filter(F.transform(F.split(marked, "\n"), lambda z: F.btrim(z, F.lit(" "))), lambda z: z != "")


def zones(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, start and units of every zone of the texts. Nothing is exchanged."""
    each = rows.select(key, typed(F.col(text)).alias("_t")).select(key, F.explode(zone_arrays(F.col("_t"))).alias("z"))
    return each.select(key, "z.start", "z.units")
