"""Lexical signals: how many patterns of each category a title and abstract hit, and the evidence bucket that follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of each category, in order.
INTRODUCES = [
    r"\bwe\s+(?:introduce|present|propose|release|create|construct|compile|curate|build)\b.{0,120}\b(?:benchmark|dataset|corpus|evaluation\s+suite|test\s+suite)\b",
    r"\bnew\s+(?:benchmark|dataset|evaluation|corpus)\b",
    r"\bnovel\s+(?:benchmark|dataset)\b",
    r"\bcontribut(?:e|ion)\b.{0,80}\b(?:benchmark|dataset)\b",
]
EVALUATES_ON = [
    r"\b(?:evaluate|test|assess|validate|experiment)(?:s|ed|ing)?\s+(?:on|across|over)\b",
    r"\bfine[\-\s]?tun(?:e|ed|ing)\s+on\b",
]
BENCHMARK_VOCAB = [
    r"(?<!existing )(?<!a existing )(?<!standard )(?<!a standard )(?<!current )(?<!a current )(?<!popular )(?<!a popular )(?<!the standard )\bbenchmark(?:s|ing)?\b",
    r"\bleaderboard\b",
]
BENCHMARK_WEAK = [
    r"\bstate[\-\s]of[\-\s]the[\-\s]art\b",
    r"\bSOTA\b",
    r"\bbaseline(?:s)?\b",
    r"\bresults?\s+on\b",
    r"\bperformanc(?:e|es)\s+on\b",
]
CLASSIF_EXPLICIT = [
    r"\btext\s+classif(?:ication|ier|iers)\b",
    r"\b(?:sentence|document|review|news|tweet|comment|message|post)\s+classif(?:ication|ier)\b",
    r"\bclassif(?:ication|y)\s+(?:task|benchmark|dataset|problem)\b",
    r"\btext\s+categori[sz]ation\b",
]
CLASSIF_TASKS = [
    r"\bsentiment\s+(?:analysis|classification|detection|prediction)\b",
    r"\bopinion\s+(?:mining|classification|detection)\b",
    r"\baspect[\-\s](?:based|level)\b.*\bsentiment\b",
    r"\b(?:sentiment|opinion)\s+polarity\b",
    r"\bpolarity\s+(?:classification|detection)\b",
    r"\bnatural\s+language\s+inference\b",
    r"\btextual\s+entailment\b",
    r"(?<!native language )\bNLI\b",
    r"\brecogniz(?:e|ing)\s+textual\s+entailment\b",
    r"\btopic\s+(?:classification|detection|categorization|labeling)\b",
    r"\bintent\s+(?:detection|classification|recognition)\b",
    r"\bdialogue?\s+act\b",
    r"\bhate\s+speech\b",
    r"\btoxic(?:ity)?\s+(?:detection|classification)\b",
    r"\boffensive\s+language\b",
    r"\babusive\s+language\b",
    r"\bspam\s+(?:detection|classification|filtering)\b",
    r"\bfake\s+news\s+(?:detection|classification)\b",
    r"\bmisinformation\s+detection\b",
    r"\brumou?r\s+(?:detection|verification)\b",
    r"\bstance\s+(?:detection|classification)\b",
    r"\birony\s+detection\b",
    r"\bsarcasm\s+detection\b",
    r"\bemotion\s+(?:detection|classification|recognition)\b",
    r"\bparaphrase\s+(?:detection|identification)\b",
    r"\bduplicate\s+(?:detection|question)\b",
    r"(?<!native )\blanguage\s+identification\b",
    r"\bgenre\s+classification\b",
    r"\bdocument\s+classif",
    r"\bfact[\-\s]?check(?:ing)?\b",
    r"\bclaim\s+(?:verification|detection)\b",
]
CLASSIF_WEAK = [
    r"\bnatural\s+language\s+understanding\b",
    r"\bNLU\b",
    r"\bsemantic\s+(?:similarity|equivalence)\b",
]
KNOWN_BENCHMARKS = [
    r"\bGLUE\b",
    r"\bSuperGLUE\b",
    r"\bSST[\-\s]?[25]\b",
    r"\bMNLI\b",
    r"\bSNLI\b",
    r"\bXNLI\b",
    r"\bANLI\b",
    r"\bRTE\b",
    r"\bMRPC\b",
    r"\bCoLA\b",
    r"\bQNLI\b",
    r"\bWNLI\b",
    r"\bPAWS\b",
    r"\bPAWS[\-\s]X\b",
    r"\bIMDb\b",
    r"\bAG[\s\']?s?\s*News\b",
    r"\b20[\s]?News(?:groups)?\b",
    r"\bYahoo[\s!]?\s*Answers?\b",
    r"\bYelp\b.*\b(?:review|polarity)\b",
    r"\bAmazon\b.*\breview\b",
    r"\bSogou\b",
    r"\bHatEval\b",
    r"\bOffComBR\b",
    r"\bOLID\b",
]
METHOD = (
    r"\bwe\s+(?:introduce|present|propose|release|create|construct|compile|curate|build)\b.{0,60}"
    r"\b(?:method|model|approach|framework|system|technique|architecture|algorithm|pipeline|tool|mechanism|set\s+of\s+experiments)\b"
)
SIGNALS = {
    "introduces": INTRODUCES,
    "evaluates_on": EVALUATES_ON,
    "benchmark_vocab": BENCHMARK_VOCAB,
    "benchmark_weak": BENCHMARK_WEAK,
    "classif_explicit": CLASSIF_EXPLICIT,
    "classif_tasks": CLASSIF_TASKS,
    "classif_weak": CLASSIF_WEAK,
    "known_classif_benchmarks": KNOWN_BENCHMARKS,
}

#: Case-blind for all letters, Unix line ends; Unicode white space stands for \s.
FLAGS = "(?iud)"
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def java(pattern: str) -> str:
    """The pattern for rlike: \\s covers all white space, inside and outside of brackets."""
    inner = SPACE[1:-1]
    return FLAGS + pattern.replace(r"[\-\s]", rf"[\-{inner}]").replace(r"[\s\']", rf"[{inner}\']").replace(r"[\s!]", rf"[{inner}!]").replace(r"[\s]", f"[{inner}]").replace(r"\s", SPACE)


#: Letters that case-blind matching takes for others beyond what lower() does.
FOLDED = ("\u017f\u0131\u0130\u212a", "siik")


def stem(pattern: str) -> str:
    """The longest run of letters and digits that every match of the pattern holds, in lower case ('' for none of three or more)."""
    best, run, depth, i = "", "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i, c = i + 1, ""
        elif c == "[":
            i, c = pattern.index("]", i), ""
        elif c == "{":
            run, i, c = run[:-1], pattern.index("}", i), ""
        depth += (c == "(") - (c == ")")
        if c and c in "?*":
            run = run[:-1]  # what may be absent
        if c.isalnum() and not depth:
            run += c
        else:
            best, run = max(best, run, key=len), ""
        i += 1
    best = max(best, run, key=len).lower()
    return best if len(best) > 2 and "|" not in pattern.split("(")[0] else ""


def hits(text: Column, patterns: list[str], folded: Column | None = None) -> Column:
    """How many of the patterns occur at least once. folded: the text in lower case, to look for a pattern's stem first."""

    def one(p: str) -> Column:
        found = text.rlike(java(p))
        return ((folded.contains(s) & found) if folded is not None and (s := stem(p)) else found).cast("int")

    return sum(map(one, patterns), F.lit(0))


def fold(text: Column) -> Column:
    return F.lower(F.translate(text, *FOLDED))


def scores(text: Column, folded: Column) -> dict[str, Column]:
    """Columns of all categories, by name; benchmark_total and classif_total need those and come from ``totals``."""
    return {c: hits(text, p, folded) for c, p in SIGNALS.items()} | {"introduces_method": text.rlike(java(METHOD)).cast("int")}


def totals() -> dict[str, Column]:
    """Weak signals count only beside a strong one."""
    strong_b = F.col("introduces") + F.col("evaluates_on") + F.col("benchmark_vocab")
    strong_c = F.col("classif_explicit") + F.col("classif_tasks") + F.col("known_classif_benchmarks")
    beside = lambda strong, weak: strong + F.when(strong >= 1, F.col(weak)).otherwise(0)
    return {"benchmark_total": beside(strong_b, "benchmark_weak"), "classif_total": beside(strong_c, "classif_weak")}


def bucket() -> Column:
    """A: introduces a benchmark for classification; B: part of that evidence; C: none. A method is no benchmark."""
    introduced = (F.col("introduces") >= 1) & (F.col("introduces_method") == 0)
    partial = (F.col("known_classif_benchmarks") >= 1) | (F.col("introduces") >= 1) | ((F.col("classif_total") >= 1) & (F.col("benchmark_vocab") >= 1))
    return F.when(introduced & (F.col("classif_total") >= 1), "A").when(partial, "B").otherwise("C")
