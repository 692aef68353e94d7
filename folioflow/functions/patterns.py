"""Rewriting and finding many fixed words at once, by one automaton for all of them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Formula commands and the characters that they stand for.
COMMANDS = (
    ("leqslant", "≤"), ("geqslant", "≥"), ("longrightarrow", "→"), ("longleftarrow", "←"), ("leftrightarrow", "↔"), ("rightarrow", "→"), ("to", "→"),
    ("leftarrow", "←"), ("downarrow", "↓"), ("uparrow", "↑"), ("emptyset", "∅"), ("subseteq", "⊆"), ("supseteq", "⊇"), ("leq", "≤"), ("le", "≤"),
    ("geq", "≥"), ("ge", "≥"), ("neq", "≠"), ("ne", "≠"), ("approx", "≈"), ("times", "×"), ("prime", "′"), ("nabla", "∇"), ("propto", "∝"),
    ("perp", "⊥"), ("parallel", "∥"), ("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("delta", "δ"), ("theta", "θ"), ("lambda", "λ"), ("sigma", "σ"),
    ("omega", "ω"), ("Omega", "Ω"), ("Gamma", "Γ"), ("Delta", "Δ"), ("Theta", "Θ"), ("Lambda", "Λ"), ("Sigma", "Σ"), ("Phi", "Φ"), ("phi", "φ"),
    ("pi", "π"), ("mu", "μ"), ("nu", "ν"), ("rho", "ρ"), ("tau", "τ"), ("chi", "χ"), ("psi", "ψ"), ("Psi", "Ψ"), ("xi", "ξ"), ("Xi", "Ξ"),
    ("eta", "η"), ("zeta", "ζ"), ("iota", "ι"), ("kappa", "κ"), ("epsilon", "ε"), ("varepsilon", "ε"), ("upsilon", "υ"), ("Upsilon", "Υ"),
    ("infty", "∞"), ("partial", "∂"), ("sum", "∑"), ("prod", "∏"), ("int", "∫"), ("sqrt", "√"), ("angle", "∠"), ("bullet", "•"), ("circ", "°"),
    ("ast", "*"), ("star", "*"), ("sim", "~"), ("pm", "±"), ("mp", "∓"), ("div", "÷"), ("cdot", "·"), ("in", "∈"), ("notin", "∉"), ("subset", "⊂"),
    ("supset", "⊃"), ("cup", "∪"), ("cap", "∩"), ("forall", "∀"), ("exists", "∃"),
)
#: Commands whose braces are taken off.
WRAPPERS = ("mathrm", "text", "textbf", "textit", "textsf", "texttt", "textup", "textsl", "textsc", "mathbb", "mathcal", "mathfrak", "mathit", "mathbf", "mathsf", "mathtt", "t")


class Automaton:
    """Finds all of some words in one pass over a text. Where found words overlap, the longer one holds, of equally long ones
    that which was named first, and of one word's the one further left."""

    def __init__(self, words: Sequence[str]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for place, word in enumerate(words):
            if word and word not in self.trie:
                self.trie.add_word(word, (-len(word), place))
        self.trie.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, place of the word) without overlaps, from left to right."""
        if not len(self.trie):
            return []
        hits = sorted((rank, end + 1 + rank[0], end + 1) for end, rank in self.trie.iter(text))
        taken, out = bytearray(len(text)), []
        for (_, place), start, end in hits:
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                out.append((start, end, place))
        return sorted(out)


@lru_cache(maxsize=32)
def automaton(words: tuple[str, ...]) -> Automaton:
    """The automaton of some words, made once in each worker."""
    return Automaton(words)


def rewritten(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    """text with every word of pairs, and a backslash right before it, replaced by what it stands for."""
    out, at = [], 0
    for start, end, place in automaton(tuple(w for w, _ in pairs)).found(text):
        begin = start - 1 if start > at and text[start - 1] == "\\" else start
        out += [text[at:begin], pairs[place][1]]
        at = end
    return "".join([*out, text[at:]])


def rewrite(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Column form of rewritten(); null stays null."""
    fixed = tuple(pairs)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rewritten(t, fixed), na_action="ignore")

    return run(text)


def clean_name(text: Column) -> Column:
    """A name out of formula markup: dollar signs, wrappers and braces go, commands become their characters, escaped
    markup signs are written out. Null is empty."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\$\$(.*?)\$\$", "$1"), r"\$(.*?)\$", "$1")
    braced = out
    for name in WRAPPERS:
        braced = F.regexp_replace(braced, rf"\\?{name}\s*\{{([^}}]*)\}}", "$1")
    braced = F.replace(braced, F.lit("\\relax"), F.lit(""))
    for _ in range(3):
        braced = F.regexp_replace(braced, r"\{\{([^}]*)\}\}", r"{$1}")
    # Most names have no braces, and only those that have go through the patterns with braces.
    bare = F.replace(out, F.lit("\\relax"), F.lit(""))
    out = rewrite(F.when(F.contains(out, F.lit("{")), F.regexp_replace(braced, r"\{([^}]*)\}", "$1")).otherwise(bare), COMMANDS)
    for entity, sign in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.trim(out), r"\s+", " ")
