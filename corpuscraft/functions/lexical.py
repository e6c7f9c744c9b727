"""Column functions on words, tags, labels and spans."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(c: Column | str, table: dict[str, str]) -> Column:
    """The value of a small fixed table, null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), col(c))


# words


def prefix5(word: Column | str) -> Column:
    """The first five characters of a longer word, else the word."""
    return F.substring(col(word), 1, 5)


def affix(word: Column | str, n: int, side: str = "prefix") -> Column:
    """The first or last n characters; a shorter word is its own affix."""
    w = col(word)
    return F.left(w, F.lit(n)) if side == "prefix" else F.when(F.length(w) <= n, w).otherwise(F.right(w, F.lit(n)))


def is_capitalized(word: Column | str) -> Column:
    """The first character is upper case; true for the empty word."""
    w = col(word)
    return (w == "") | w.rlike(r"^\p{Lu}")


def is_punct(word: Column | str) -> Column:
    """The whole word is Unicode punctuation; symbols such as a currency sign are not."""
    return col(word).rlike(r"^\p{IsPunctuation}+$")


#: What stays of a word besides ASCII letters, digits and the underscore.
ACCENTED = "ÁÉÍÓÚÜÑáéíóúüñ"


def escape_word(word: Column | str) -> Column:
    """Every character that is no ASCII letter, digit, underscore or one of ACCENTED becomes an underscore."""
    return F.regexp_replace(col(word), f"[^A-Za-z0-9_{ACCENTED}]", "_")


def norm_digits(word: Column | str) -> Column:
    """A run of digits becomes one 0."""
    return F.regexp_replace(col(word), r"[0-9]+", "0")


def clean(word: Column | str) -> Column:
    return norm_digits(F.lower(escape_word(word)))


def hash_signs(word: Column | str) -> Column:
    """Digits to number signs, as embeddings of normalized text have them."""
    return F.regexp_replace(col(word), "[0-9]", "#")


# tags and labels

#: The 45 tags of the Penn treebank and the coarse tag (of 17) of each.
PTB_COARSE = {
    "#": "ADJ", "$": "ADJ", "''": "RPUNC", ",": "INPUNC", "-LRB-": "LPUNC", "-RRB-": "RPUNC", ".": "ENDPUNC", ":": "INPUNC", "CC": "CONJ", "CD": "ADJ",
    "DT": "DET", "EX": "N", "FW": "N", "IN": "PREP", "JJ": "ADJ", "JJR": "ADJ", "JJS": "ADJ", "LS": "INPUNC", "MD": "V", "NN": "N",
    "NNP": "N", "NNPS": "N", "NNS": "N", "PDT": "DET", "POS": "POS", "PRP": "N", "PRP$": "ADJ", "RB": "ADV", "RBR": "ADV", "RBS": "ADV",
    "RP": "PRT", "SYM": "INPUNC", "TO": "TO", "UH": "INPUNC", "VB": "V", "VBD": "V", "VBG": "VBG", "VBN": "VBN", "VBP": "V", "VBZ": "V",
    "WDT": "W", "WP": "W", "WP$": "W", "WRB": "W", "``": "LPUNC",
}

#: Coarse tags with a strict kind, and fine tags of punctuation and conjunctions.
STRICT_COARSE = {".": "PUNC", "CONJ": "CONJ", "NOUN": "NOUN", "VERB": "VERB"}
PUNC_TAGS = ("$,", "$.", ",", ";", "F", "IK", "PUNC", "Punc", "XP", "punc")
CONJ_TAGS = ("CC", "Conj", "Conjunction", "KON", "cc", "conj")


def strict_pos(pos: Column | str, cpos: Column | str | None = None) -> Column:
    """VERB, NOUN, PUNC, CONJ or OTHER: by the coarse tag where that has a kind, else by the fine one: v and n begin verbs and nouns, the rest are lists."""
    p = col(pos)
    fine = F.when(p.rlike("^[vV]"), "VERB").when(p.rlike("^[nN]"), "NOUN").when(p.isin(*PUNC_TAGS), "PUNC").when(p.isin(*CONJ_TAGS), "CONJ")
    return F.coalesce(*([lookup(cpos, STRICT_COARSE)] if cpos is not None else []), fine, F.lit("OTHER"))


#: How the tags of each language begin (True), or what they are (False), for nouns and verbs.
KINDS = {"ca": (False, "n", "v"), "cs": (False, "N", "V"), "de": (True, "N", "V"), "en": (True, "N", "V"), "es": (False, "n", "v"), "zh": (True, "N", "V")}


def _of_kind(pos: Column | str, lang: str, which: int) -> Column:
    if lang not in KINDS:
        raise ValueError(f"unknown language {lang}")
    begins, value = KINDS[lang][0], KINDS[lang][which]
    return col(pos).startswith(value) if begins else col(pos) == value


def is_noun(pos: Column | str, lang: str = "en") -> Column:
    return _of_kind(pos, lang, 1)


def is_verb(pos: Column | str, lang: str = "en") -> Column:
    return _of_kind(pos, lang, 2)


def ptb45_to_17(pos: Column | str) -> Column:
    """The coarse tag of a Penn tag; null for other tags."""
    return lookup(pos, PTB_COARSE)


def normalize_role(role: Column | str) -> Column:
    """What stands before the first hyphen, lower-cased; an underscore stays."""
    r = col(role)
    return F.when(r == "_", r).otherwise(F.lower(F.split_part(r, F.lit("-"), F.lit(1))))


def sense_suffix(label: Column | str) -> Column:
    """What follows the last dot, or the label if there is none."""
    x = col(label)
    return F.when(x.rlike(r".+\.(.+)"), F.regexp_extract(x, r".+\.(.+)", 1)).otherwise(x)


#: The ending of an unseen predicate's sense, by language, and for es and ca by the kind of word.
SENSES = {"de": "1", "en": "01", "zh": "01"}
SENSE_KINDS = {"auxiliary": "c2", "common": "a2", "main": "a2", "qualificative": "b2", "semiauxiliary": "c2"}


def default_sense(lemma: Column | str, feats: Column | str | None = None, lang: str = "en") -> Column:
    """The sense of an unseen predicate: the lemma, a dot and an ending; for es and ca that of the first kind of SENSE_KINDS that the features name, else a2."""
    if lang in SENSES:
        return F.concat(col(lemma), F.lit(f".{SENSES[lang]}"))
    if lang not in ("es", "ca"):
        raise ValueError(f"no default sense for language {lang}")
    joined = F.array_join(col(feats), "_") if feats is not None else F.lit(None).cast("string")
    named = [F.when(joined.contains(f"postype={kind}"), ending) for kind, ending in SENSE_KINDS.items()]
    return F.concat_ws(".", col(lemma), F.coalesce(*named, F.lit("a2")))


def null_if_underscore(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit("_"))


def underscore_if_null(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit("_"))


def split_feats(x: Column | str) -> Column:
    """The values between vertical bars; null for an underscore."""
    return F.split(null_if_underscore(x), r"\|")


def join_feats(x: Column | str) -> Column:
    return F.coalesce(F.array_join(col(x), "|"), F.lit("_"))


def morpho_str(x: Column | str) -> Column:
    """The features joined by underscores, NO_MORPH if there is none."""
    return F.coalesce(F.array_join(F.when(F.size(col(x)) > 0, col(x)), "_"), F.lit("NO_MORPH"))


def morpho6(x: Column | str) -> Column:
    """Exactly six values, padded with NO_MORPH."""
    return F.slice(F.concat(F.coalesce(col(x), F.array().cast("array<string>")), F.array_repeat(F.lit("NO_MORPH"), 6)), 1, 6)


# relations


def build_label(kind: Column | str, sub: Column | str, role1: Column | str, role2: Column | str) -> Column:
    """``type-subtype(role1,role2)``, without the subtype where it is null."""
    return F.concat(col(kind), F.coalesce(F.concat(F.lit("-"), col(sub)), F.lit("")), F.lit("("), col(role1), F.lit(","), col(role2), F.lit(")"))


def parse_label(label: Column | str) -> Column:
    """type, subtype, role1 and role2 of a label; null if it isn't of that form."""
    x, form = col(label), r"^([^-(]+)(?:-([^(]+))?\(([^,]+),(.+)\)$"
    part = lambda i: F.nullif(F.regexp_extract(x, form, i), F.lit(""))
    return F.when(x.rlike(form), F.struct(part(1).alias("type"), part(2).alias("subtype"), part(3).alias("role1"), part(4).alias("role2")))


def is_norel(label: Column | str) -> Column:
    """The label says that there is no relation. A null says nothing."""
    return F.coalesce(col(label).rlike("^(NO_RELATION|Other)"), F.lit(False))


#: Relation types whose two arguments play different parts.
ASYMMETRIC = ("ART", "GEN-AFF", "ORG-AFF", "PART-WHOLE")


def is_asymmetric(kind: Column | str) -> Column:
    """DISC, a type of older annotation with other rules, is an error."""
    k = col(kind)
    return F.when(k == "DISC", F.raise_error(F.lit("DISC relations aren't supported")).cast("boolean")).otherwise(k.isin(*ASYMMETRIC))


#: Bits of a cluster that stand for a missing entity type and subtype.
TYPE_BITS, SUBTYPE_BITS = 6, 8


def entity_type_or(kind: Column | str, cluster: Column | str | None = None, bits: int = TYPE_BITS) -> Column:
    """The entity type, else the first ``bits`` of the cluster of its head, else NOTYPE."""
    return F.coalesce(col(kind), *([F.substring(col(cluster), 1, bits)] if cluster is not None else []), F.lit("NOTYPE"))


#: Labels of properties, and those that count as none.
LIKELY, UNLIKELY, NOT_AN_ARG = "LIKELY", "UNLIKELY", "NOT_AN_ARG"
SPRL_NIL = ("NA", "NOT_AN_ARG", "UNLIKELY")


def sprl_label(value: Column | str, applicable: Column | str | None = None, threshold: float = 4.0) -> Column:
    """LIKELY if the property applies and its value reaches the threshold, else UNLIKELY."""
    applies = col(applicable) if applicable is not None else F.lit(True)
    return F.when(F.coalesce(applies & (col(value) >= threshold), F.lit(False)), LIKELY).otherwise(UNLIKELY)


def sprl_value(label: Column | str) -> Column:
    """5 for LIKELY, 1 for UNLIKELY; any other label is an error."""
    x = col(label)
    return F.when(x == LIKELY, 5.0).when(x == UNLIKELY, 1.0).when(x.isNotNull(), F.raise_error(F.concat(F.lit("no property label: "), x)).cast("double"))


# numbers, lists and vectors


def bin_int(x: Column | str, *bins: int) -> Column:
    """The largest threshold that x reaches (0, 2, 5, 10, 20, 30, 40); the least integer if it reaches none."""
    bins = bins or (0, 2, 5, 10, 20, 30, 40)
    return reduce(lambda out, b: F.when(col(x) >= b, b).otherwise(out), sorted(bins), F.lit(-(2**31)))


def scale_vec(vec: Column | str, mode: str = "l2", alpha: float = 1.0) -> Column:
    """A vector scaled to L1 or L2 length one, to mean 0 and deviation 1 ("std"), or not at all ("none"), times alpha."""
    v = F.transform(col(vec), lambda x: x.cast("double"))
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + f(x))

    def each(value: Column, f) -> Column:
        """f(x, value) of each component, the value computed once."""
        return F.get(F.transform(F.array(value), lambda t: F.transform(v, lambda x: f(x, t))), F.lit(0))

    if mode == "l1":
        return each(total(F.abs), lambda x, t: alpha * x / t)
    if mode == "l2":
        return each(F.sqrt(total(lambda y: y * y)), lambda x, t: alpha * x / t)
    if mode == "std":
        n = F.size(v)
        sums = F.aggregate(v, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda acc, x: F.struct((acc["a"] + x).alias("a"), (acc["b"] + x * x).alias("b")))
        return each(sums, lambda x, t: alpha * (x - t["a"] / n) / F.sqrt(t["b"] / n - t["a"] * t["a"] / n / n))
    return F.transform(v, lambda x: alpha * x)


def harmonic_mean(p: Column | str, r: Column | str) -> Column:
    """0 if both are."""
    return F.when(col(p) + col(r) == 0, 0.0).otherwise(2 * col(p) * col(r) / (col(p) + col(r)))


def ngrams(items: Column | str, n: int) -> Column:
    """As many n-grams as the list has items, each ending at one of them, joined by underscores; BOS stands before the first item."""
    padded = lambda x: F.struct(x.alias("x"), F.concat(F.array_repeat(F.lit("BOS"), n - 1), x).alias("padded"))
    return let(col(items), lambda x: let(padded(x), lambda y: F.transform(y["x"], lambda _, i: F.array_join(F.slice(y["padded"], i + 1, n), "_"))))


def no_dup(items: Column | str) -> Column:
    """Adjacent repeats collapsed."""
    return let(col(items), lambda x: F.filter(x, lambda v, i: (i == 0) | ~v.eqNullSafe(F.get(x, i - 1))))


def bag(items: Column | str) -> Column:
    """The distinct values in order."""
    return F.array_sort(F.array_distinct(col(items)))


# spans: struct<start:int,end:int>, half open


def span(start: Column | str | int, end: Column | str | int) -> Column:
    as_int = lambda x: (F.lit(x) if isinstance(x, int) else col(x)).cast("int")
    return F.struct(as_int(start).alias("start"), as_int(end).alias("end"))


def slice_span(layer: Column | str, s: Column | str) -> Column:
    """The part of a layer that a span covers."""
    return F.slice(col(layer), col(s)["start"] + 1, col(s)["end"] - col(s)["start"])


def span_text(words: Column | str, s: Column | str, sep: str = " ") -> Column:
    return F.array_join(slice_span(words, s), sep)


def span_contains(a: Column | str, b: Column | str) -> Column:
    """Span b lies within a."""
    return (col(a)["start"] <= col(b)["start"]) & (col(b)["end"] <= col(a)["end"])


def span_has(a: Column | str, i: Column | str) -> Column:
    return (col(a)["start"] <= col(i)) & (col(i) < col(a)["end"])


def spans_overlap(a: Column | str, b: Column | str) -> Column:
    return (col(a)["start"] < col(b)["end"]) & (col(b)["start"] < col(a)["end"])


def span_before(a: Column | str, b: Column | str) -> Column:
    """Span a begins before b."""
    return col(a)["start"] < col(b)["start"]


def span_between(a: Column | str, b: Column | str) -> Column:
    """What lies between two spans; empty at the later one's begin if they touch or overlap."""
    first = F.when(span_before(a, b), col(a)).otherwise(col(b))
    second = F.when(span_before(a, b), col(b)).otherwise(col(a))
    return span(F.least(first["end"], second["start"]), second["start"])


# sentences


def has_verb(pos: Column | str) -> Column:
    """The tags hold a finite verb, or a modal and a base form."""
    p = col(pos)
    return F.arrays_overlap(p, F.array(*map(F.lit, ("VBP", "VBD", "VBZ")))) | (F.array_contains(p, "MD") & F.array_contains(p, "VB"))
