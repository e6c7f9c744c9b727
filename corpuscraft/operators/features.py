"""Feature rows from templates: specs that become column expressions over whole sentences.

A sentence is one row of arrays, and its examples are an array in it, so features need neither a join nor a copy of the
sentence for each example. What an example points at is its key: p and c, and where it has them a modifier m, the begin, middle and end ri, rj, rk of a rule
(with its symbols, rule_parent, rule_left, rule_right), the heads h1, h2 of two mentions and their ends m1s, m1e, m1h, m2s, m2e, m2h. Rows are (key, template, feature).
With ``hashed`` a feature is the 64-bit hash of what would be its text.

Templates are compiled together. Their parts are evaluated once an example, inside the sentence's row; trees are asked through an
index that the row has once (functions.tree_index). Joint templates are put together from those values along a trie of their
parts, so what two templates begin with is joined once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tree_index, trees
from ..functions.hashing import hash_feature
from ..functions.lexical import affix, bag, bin_int, is_capitalized, is_noun, is_verb, morpho6, morpho_str, ngrams, no_dup, strict_pos
from . import masks
from .tables import KEYS, settled


@dataclass(frozen=True)
class Token:
    """The property of one token. position: p, c or another of PLACES. modifier: one of MODIFIERS, or several from the outermost on, joined by a slash."""

    prop: str
    position: str = "p"
    modifier: str = "self"

    def name(self) -> str:
        inner = self.position
        for m in reversed(self.modifier.split("/")):
            inner = inner if m == "self" else f"{m}({inner})"
        return f"{self.prop}({inner})"

    def layers(self) -> set[str]:
        own = {_layer(self.prop)} if self.prop != "index" else {"words"}
        steps = [m for m in self.modifier.split("/") if m not in ("self", "before1", "before2", "after1", "after2")]
        return own | ({"parents"} if steps else set()) | ({"pos"} if any("_" in m for m in steps) else set())


@dataclass(frozen=True)
class List:
    """A property along a list of tokens. source: one of SOURCES. form: one of FORMS. edge: what goes between the tokens of a path: dir (UP, DOWN), rel (the edge's relation) or nothing; without a prop there is that alone."""

    prop: str | None
    source: str = "path"
    form: str = "seq"
    position: str = "p"
    edge: str | bool = ""

    def _edge(self) -> str:
        return "dir" if self.edge is True else self.edge or ""

    def name(self) -> str:
        where = self.source if self.source in (*PATHS, "line", "between", "rule") else f"{self.source}({self.position})"
        return f"{self.form}({'&'.join(filter(None, (self.prop, self._edge())))}({where}))"

    def layers(self) -> set[str]:
        own = {_layer(self.prop)} if self.prop else {"words"}
        return own | ({"deprels"} if self._edge() == "rel" else set()) | ({"parents"} if self.source not in ("line", "between", "rule") else set())


@dataclass(frozen=True)
class Pair:
    """A feature of the example itself, mostly of two of its places. kind: one of KINDS."""

    kind: str
    one: str = "p"
    two: str = "c"

    def name(self) -> str:
        return self.kind.upper() + (f"({self.one},{self.two})" if (self.one, self.two) != ("p", "c") else "")

    def layers(self) -> set[str]:
        return {"words"} | ({"parents"} if self.kind in ON_PATHS or "edge" in self.kind else set()) | ({"pos"} if self.kind == "path_grams" else set())


@dataclass(frozen=True)
class Joint:
    """Several templates at once: one feature for each choice of a feature of every part."""

    parts: tuple

    def name(self) -> str:
        return "+".join(p.name() for p in self.parts)

    def layers(self) -> set[str]:
        return set().union(*(p.layers() for p in self.parts))


@dataclass(frozen=True)
class Rule:
    """A symbol of the example's rule: parent, left or right; a missing right one is none."""

    piece: str

    def name(self) -> str:
        return f"rule_{self.piece}"

    def layers(self) -> set[str]:
        return set()


#: The columns of an example's key.
PLACES = ("p", "c", "m", "ri", "rj", "rk", "h1", "h2", "m1s", "m1e", "m1h", "m2s", "m2e", "m2h")
RULE = ("rule_parent", "rule_left", "rule_right")
Template = Token | List | Pair | Joint | Rule
PATHS = ("path", "path_p_lca", "path_c_lca", "path_lca_root")
SOURCES = (*PATHS, "line", "between", "rule", "children", "no_far_children")
FORMS = ("seq", "bag", "no_dup", "1gram", "2gram", "3gram")
MODIFIERS = ("self", "before1", "before2", "after1", "after2", "head", *tree_index.NEAR, "low_verb", "high_verb", "low_noun", "high_noun")
#: relative: BEFORE, AFTER, ON; edge: either is the other's parent; direction_edge: the first is the second's.
KINDS = ("relative", "distance", "edge", "direction_edge", "genealogy", "continuity", "path_len", "sent_len", "path_grams", "rule_is_unary")
ON_PATHS = ("genealogy", "continuity", "path_len", "path_grams")
PROPS = {
    "word": "words", "lc": "words", "cap": "words", "capitalized": "words", "wordTopN": "words_top", "lemma": "lemmas", "pos": "pos", "spos": "pos", "cpos": "cpos", "cluster": "clusters", "bc0": "clusters", "bc1": "clusters",
    "prefix": "prefixes", "chunk": "chunks", "ne": "ne_tags", "deprel": "deprels", "predSense": "senses", "index": "words", "morpho": "feats", "eachmorpho": "feats", "morpho1": "feats", "morpho2": "feats", "morpho3": "feats",
} | {f"{side}{n}": "words" for side in ("chpre", "chsuf") for n in range(1, 6)}
#: Properties with several values a token.
EACH = ("eachmorpho",)


def _layer(prop: str) -> str:
    return PROPS.get(prop, prop)


def required_layers(templates: Iterable[Template]) -> set[str]:
    return set().union(*(t.layers() for t in templates))


def filter_templates(templates: Iterable[Template], have: Iterable[str]) -> list[Template]:
    """Those whose layers are all there."""
    known = set(have)
    return [t for t in templates if t.layers() <= known]


def union_templates(*sets: Iterable[Template]) -> list[Template]:
    return list(dict.fromkeys(t for s in sets for t in s))


# specs

# fixed values: names that template files in wide use have for lists, modifiers, forms, edges and features of the whole example
LISTS = {
    "path(lca(p,c),root)": ("path_lca_root", "p"), "path(p,lca(p,c))": ("path_p_lca", "p"), "path(c,lca(p,c))": ("path_c_lca", "p"), "path(p,c)": ("path", "p"), "line(p,c)": ("line", "p"), "line(ri,rk)": ("rule", "p"),
    "btwn(p,c)": ("between", "p"), "children(p)": ("children", "p"), "children(c)": ("children", "c"), "noFarChildren(p)": ("no_far_children", "p"), "noFarChildren(c)": ("no_far_children", "c"),
}
OTHER_MODIFIERS = {"0": "self", "-1": "before1", "-2": "before2", "1": "after1", "2": "after2", "lowsv": "low_verb", "highsv": "high_verb", "lowsn": "low_noun", "highsn": "high_noun"}
OTHER_FORMS = {"noDup": "no_dup"}
EDGES = {"dir": "dir", "edgerel": "rel"}
WHOLE = {"pathGrams": Pair("path_grams"), "sentlen": Pair("sent_len"), "ruleIsUnary": Pair("rule_is_unary"), "len(path(p,c))": Pair("path_len"), "continuity(path(p,c))": Pair("continuity"), "tag(ruleP)": Rule("parent"), "tag(ruleLc)": Rule("left"), "tag(ruleRc)": Rule("right")}
OF_TWO = {"relative": "relative", "distance": "distance", "undiredge": "edge", "diredge": "direction_edge", "geneology": "genealogy", "genealogy": "genealogy"}


def parse_spec(lines: Iterable[str], unknown: str = "error") -> list[Template]:
    """A template a line, its parts joined by ``+``. Comments and blank lines are skipped.

    Parts are as templates name themselves, ``word(p)``, ``pos(head(c))``, ``bag(pos(path))``, ``seq(deprel&dir(path))``, ``DISTANCE``, or as in ``deprel(dir(seq(path(p,c))))``, ``pos(-1(c))``, ``relative(p,c)``: a property, then an edge property and a
    form, in any order, around a list; or a property around modifiers around a place. unknown: what to do with a line that has another
    part, an error or "skip".
    """
    out = []
    for line in lines:
        text = line.split("#")[0].strip()
        if text:
            try:
                parts = tuple(_parse_one(re.sub(r"\s", "", part)) for part in text.split("+"))
            except ValueError:
                if unknown == "error":
                    raise
                continue
            out.append(parts[0] if len(parts) == 1 else Joint(parts))
    return out


def _parse_one(text: str) -> Template:
    if text in WHOLE:
        return WHOLE[text]
    if text in RULE:
        return Rule(text.removeprefix("rule_"))
    if text.lower() in KINDS:
        return Pair(text.lower())
    two = re.fullmatch(r"(\w+)\((\w+),(\w+)\)", text)
    if two and two[1].lower() in OF_TWO and {two[2], two[3]} <= set(PLACES):
        return Pair(OF_TWO[two[1].lower()], two[2], two[3])
    names = text.rstrip(")").split("(")
    if len(names) < 2 or text.count(")") != len(names) - 1 or text.count("(") != text.count(")"):
        raise ValueError(f"no template: {text}")
    if names[0] in FORMS and 2 < len(names) < 5 and names[2] in SOURCES and (len(names) == 3 or names[3] in PLACES):
        prop, _, edge = names[1].partition("&")
        prop, edge = ("", prop) if prop in EDGES.values() and not edge else (prop, edge)
        return _checked(List(prop or None, names[2], names[0], names[3] if len(names) > 3 else "p", edge), text)
    for name, (source, position) in LISTS.items():
        if name in text:
            return _parse_list(text, text[: text.index(name)], name, source, position)
    steps = [OTHER_MODIFIERS.get(m, m) for m in names[1:-1] if m != "0"] or ["self"]
    return _checked(Token(names[0], names[-1], "/".join(steps)), text)


def _parse_list(text: str, around: str, name: str, source: str, position: str) -> List:
    outer = [x for x in around.split("(") if x]
    if text != "(".join([*outer, name]) + ")" * len(outer):
        raise ValueError(f"no template: {text}")
    forms = [OTHER_FORMS.get(x, x) for x in outer if OTHER_FORMS.get(x, x) in FORMS]
    edges = [EDGES[x] for x in outer if x in EDGES]
    props = [x for x in outer if x not in EDGES and OTHER_FORMS.get(x, x) not in FORMS]
    if len(forms) > 1 or len(edges) > 1 or len(props) > 1 or not edges and not props or edges and source not in PATHS:
        raise ValueError(f"no template: {text}")
    return _checked(List(props[0] if props else None, source, forms[0] if forms else "seq", position, edges[0] if edges else ""), text)


def _checked(t: Token | List, text: str) -> Token | List:
    if t.prop is not None and t.prop not in PROPS or t.position not in PLACES or isinstance(t, Token) and not set(t.modifier.split("/")) <= set(MODIFIERS):
        raise ValueError(f"no template: {text}")
    return t


def read_template_sets(spark: SparkSession, path: str, unknown: str = "error") -> dict[str, list[Template]]:
    """The template files of a folder, or a file, by name (without what follows a point): parse_spec of their lines."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()
    return {row.name.split(".")[0]: parse_spec(row.value.split("\n"), unknown) for row in files}


def with_dir_edge(templates: Iterable[Template]) -> list[Template]:
    """Each template, and each joined with the directed edge."""
    return [x for t in templates for x in (t, Joint((*(t.parts if isinstance(t, Joint) else (t,)), Pair("direction_edge"))))]


def all_unigrams(props: Iterable[str] = ("word", "lemma", "pos", "cluster", "deprel"), places: Iterable[str] = ("p", "c")) -> list[Template]:
    """Every single template over the properties: each of them at each place and modifier, along each list in each form, edges of paths with or without a property, rules, and features of the whole example."""
    props = list(props)
    out: list[Template] = [Token(p, at, m) for at in places for m in MODIFIERS for p in props]
    singles = [p for p in props if p not in EACH]
    lists = [("children", "p"), ("children", "c"), ("no_far_children", "p"), ("no_far_children", "c"), ("line", "p"), ("between", "p"), ("rule", "p")]
    out += [List(p, source, form, at) for source, at in lists for form in FORMS for p in singles]
    out += [List(p, source, form, "p", edge) for source in PATHS for form in FORMS for edge in ("", "dir", "rel") for p in (None, *singles) if p or edge]
    return out + [Rule(piece) for piece in ("parent", "left", "right")] + [Pair(k) for k in KINDS]


def all_bigrams(templates: Iterable[Template]) -> list[Template]:
    return [Joint(pair) for pair in combinations(list(templates), 2)]


# ready-made sets, each from a rule


def tag_set() -> list[Template]:
    """For tagging: the word, its affixes, its neighbours and their clusters."""
    out: list[Template] = [Token(p, "c", m) for p in ("word", "cluster") for m in ("self", "before1", "before2", "after1", "after2")]
    return out + [Token(f"{p}{n}", "c") for p in ("chpre", "chsuf") for n in range(1, 5)] + [Token("cap", "c")]


def arc_set() -> list[Template]:
    """For dependency arcs: words and tags of both ends, of their neighbours, and between them, each with the arc's direction and distance."""
    word, tag = (lambda at: Token("word", at)), (lambda at, m="self": Token("pos", at, m))
    base: list[Template] = [word("p"), word("c"), tag("p"), tag("c")]
    base += [Joint(x) for x in combinations([word("p"), tag("p"), word("c"), tag("c")], 2)]
    base += [Joint(x) for x in combinations([word("p"), tag("p"), word("c"), tag("c")], 3)]
    base += [Joint((tag("p"), tag("p", a), tag("c", b), tag("c"))) for a in ("before1", "after1") for b in ("before1", "after1")]
    base += [Joint((tag("p"), List("pos", "between", "1gram"), tag("c")))]
    return [x for t in base for x in (t, Joint((*(t.parts if isinstance(t, Joint) else (t,)), Pair("relative"), Pair("distance"))))]


def role_set() -> list[Template]:
    """For semantic roles: both ends, the path between them and its grams, children and supports."""
    out: list[Template] = [Token(p, at) for p in ("word", "lemma", "pos", "deprel") for at in "pc"]
    out += [Token("pos", "c", m) for m in ("lns", "rns", "lmc", "rmc", "head")] + [Token("word", "p", m) for m in ("low_verb", "high_verb")]
    out += [List("pos", "path", edge="dir"), List("deprel", "path", edge="dir"), List("word", "between", "bag"), List("pos", "children", "bag", "p")]
    return out + [Pair(k) for k in ("relative", "distance", "genealogy", "path_len", "path_grams", "continuity")]


def sense_set() -> list[Template]:
    return [Token(p, "p", m) for p in ("word", "lemma", "pos") for m in ("self", "before1", "after1", "head")] + [List("deprel", "children", "bag", "p")]


TEMPLATE_SETS = {"tag": tag_set, "arc": arc_set, "role": role_set, "sense": sense_set}


def template_set(name: str) -> list[Template]:
    return TEMPLATE_SETS[name]()


# evaluation


def _value(prop: str, i: Column) -> Column:
    """A property of token i; BOS and EOS beyond the sentence, null where the layer has none."""
    base = prop.rstrip("12345")
    if base in ("chpre", "chsuf"):
        v = affix(F.get("words", i), int(prop[len(base) :]), "prefix" if base == "chpre" else "suffix")
    elif base == "morpho" and base != prop:
        v = F.get(morpho6(F.get("feats", i)), F.lit(int(prop[-1]) - 1))
    else:
        known = {
            "lc": lambda: F.lower(F.get("words", i)), "cap": lambda: is_capitalized(F.get("words", i)).cast("string"), "capitalized": lambda: F.when(is_capitalized(F.get("words", i)), "UC").otherwise("LC"),
            "spos": lambda: strict_pos(F.get("pos", i)), "bc0": lambda: F.substring(F.get("clusters", i), 1, 5), "index": lambda: i.cast("string"), "morpho": lambda: morpho_str(F.get("feats", i)),
        }
        v = known[prop]() if prop in known else F.get(F.col(_layer(prop)), i)
    return F.when(i < 0, "BOS").when(i >= F.size("words"), "EOS").otherwise(v)


def _step(at: Column, modifier: str) -> Column:
    if modifier == "self":
        return at
    if modifier.startswith(("before", "after")):
        return at + int(modifier[-1]) * (1 if modifier.startswith("after") else -1)
    if modifier == "head":
        return F.when(at >= 0, F.get("parents", at))
    if "_" in modifier:
        which, kind = modifier.split("_")
        return F.coalesce(F.get(F.col(f"_{kind}s.{which}"), at), F.lit(-1))
    if modifier in ("lns", "rns"):
        return F.coalesce(F.get(F.col(f"_near.{modifier}"), at), F.lit(-1) if modifier == "lns" else F.size("words"))
    # children of the wall are all on its right
    walls = {"rnc": F.array_min, "rmc": F.array_max}[modifier](trees.children("parents", F.lit(-1))) if modifier[0] == "r" else F.lit(None)
    return F.coalesce(F.when(at == -1, walls).otherwise(F.get(F.col(f"_near.{modifier}"), at)), F.lit(-2))


def _kids(at: Column) -> Column:
    return F.when(at >= 0, F.get("_kids", at)).otherwise(trees.children("parents", at))


def _text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.array(x.cast("string"))).otherwise(F.array().cast("array<string>"))


def _along(path: Column, ups: Column, prop: str | None, edge: str) -> Column:
    """The property of each token of a path, and what its edge to the next has."""

    def items(toks: Column) -> Column:
        def one(tok: Column, k: Column) -> Column:
            up = k < ups
            own = [_value(prop, tok)] if prop else []
            if edge:
                mark = F.when(up, "UP").otherwise("DOWN") if edge == "dir" else F.get("deprels", F.when(up, tok).otherwise(F.get(toks, k + 1)))
                own.append(F.when(k < F.size(toks) - 1, mark))
            return F.array_compact(F.array(*own))

        return F.flatten(F.transform(toks, one)) if edge else F.array_compact(F.transform(toks, lambda tok: _value(prop, tok)))

    return trees.let(path, items)


def _many(t: Template) -> bool:
    """Whether a template can have several features of an example."""
    return isinstance(t, Token) and t.prop in EACH or isinstance(t, List) and t.form.endswith("gram") or isinstance(t, Pair) and t.kind == "path_grams"


def _evaluate(t: Template, ex: Callable[[str], Column]) -> Column:
    """The feature of a template that isn't joint on an example whose key ex returns by name: a text or null, or an array of them."""
    if isinstance(t, Rule):
        return ex(f"rule_{t.piece}")
    if isinstance(t, Token):
        at = ex(t.position)
        for m in reversed(t.modifier.split("/")):
            at = _step(at, m)
        return F.coalesce(F.get("feats", at), F.array().cast("array<string>")) if t.prop in EACH else _value(t.prop, at)
    if isinstance(t, List):
        p, c, at = ex("p"), ex("c"), ex(t.position)
        if t.source in PATHS:
            items = ex(_along_name(t))
        else:
            toks = {"rule": lambda: trees.line_path(ex("ri"), ex("rk")), "line": lambda: trees.line_path(p, c), "between": lambda: trees.between(p, c), "children": lambda: _kids(at), "no_far_children": lambda: trees.let(_kids(at), lambda kids: trees.inner(kids, at))}[t.source]()
            items = F.array_compact(F.transform(toks, lambda i: _value(t.prop, i)))
        if t.form.endswith("gram"):
            return F.coalesce(ngrams(items, int(t.form[0])) if t.form[0] != "1" else items, F.array(F.lit("NO_PATH")))
        shaped = {"seq": lambda: items, "bag": lambda: bag(items), "no_dup": lambda: no_dup(items)}[t.form]()
        return F.coalesce(F.array_join(shaped, "_"), F.lit("NO_PATH"))
    one, two = ex(t.one), ex(t.two)
    headed = lambda i, by: F.coalesce((i >= 0) & (F.get("parents", i) == by), F.lit(False))
    true_false = lambda x: F.when(x, "T").otherwise("F")
    kinds = {
        "relative": lambda: trees.relative_position(one, two),
        "distance": lambda: F.abs(two - one),
        "edge": lambda: true_false(headed(two, one) | headed(one, two)),
        "direction_edge": lambda: true_false(headed(two, one)),
        "rule_is_unary": lambda: true_false(ex("rule_right").isNull()),
        "genealogy": lambda: trees.kin("parents", one, two, ex("_way")),
        "continuity": lambda: trees.continuity(ex("_way")["toks"]),
        "path_len": lambda: bin_int(F.coalesce(F.size(ex("_way")["toks"]), F.lit(0))),
        "sent_len": lambda: bin_int(F.size("words")),
        "path_grams": lambda: F.coalesce(ex("_grams"), F.array(F.lit("NO_PATH"))),
    }
    found = kinds[t.kind]()
    return found if t.kind == "path_grams" else found.cast("string")


def _along_name(t: List) -> str:
    return f"_along_{t.source}_{t.prop or ''}_{t._edge()}"


def _valued(prop: str) -> Callable[..., Column]:
    return lambda _, i: _value(prop, i).cast("string")


def _indexed(examples: DataFrame, units: list[Template], lang: str) -> DataFrame:
    """examples with what the templates ask of the trees: paths by example, neighbours, children and supports by token."""
    along = {_along_name(t): t for t in units if isinstance(t, List) and t.source in PATHS}
    kinds = {t.kind for t in units if isinstance(t, Pair)}
    steps = {m for t in units if isinstance(t, Token) for m in t.modifier.split("/")}
    pairs = F.transform("examples", lambda e: F.struct(e["p"].cast("int").alias("a"), e["c"].cast("int").alias("b")))
    out = {}
    if kinds & {"genealogy", "continuity", "path_len"}:
        out["_way"] = tree_index.paths("parents", pairs)
    if "path_grams" in kinds:
        out["_grams"] = tree_index.path_grams("parents", pairs, "words", "pos")
    for name, t in along.items():  # the property of each token once, then along all paths
        layer = F.transform("words", _valued(t.prop)) if t.prop else F.lit(None).cast("array<string>")
        out[name] = tree_index.path_texts("parents", pairs, layer, t.source, t._edge(), "deprels" if t._edge() == "rel" else None)
    if steps & set(tree_index.NEAR):
        out["_near"] = tree_index.near("parents")
    if any(isinstance(t, List) and "children" in t.source for t in units):
        out["_kids"] = tree_index.children_of_all("parents")
    for kind, test in (("noun", is_noun), ("verb", is_verb)):
        if steps & {f"low_{kind}", f"high_{kind}"}:
            out[f"_{kind}s"] = tree_index.supports("parents", _flags(test, lang))
    return tree_index.batched(examples).withColumns(out) if out else examples


def _flags(test: Callable[..., Column], lang: str) -> Column:
    return F.transform("pos", lambda t: F.coalesce(test(t, lang), F.lit(False)))


def _labelled(t: Template, features: str) -> Column:
    return F.transform(features, lambda f: F.struct(F.lit(t.name()).alias("template"), f.alias("feature")))


def _crossed(a: Column, a_many: bool, b: Column, b_many: bool) -> Column:
    if a_many and b_many:
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit("_"), y))))
    if a_many:
        return F.when(b.isNotNull(), F.transform(a, lambda x: F.concat(x, F.lit("_"), b)))
    return F.when(a.isNotNull(), F.transform(b, lambda y: F.concat(a, F.lit("_"), y))) if b_many else F.concat(a, F.lit("_"), b)


def extract(examples: DataFrame, templates: Iterable[Template], hashed: bool = False, mod: int | None = None, lang: str = "en") -> DataFrame:
    """(keys, the places of the example's key, template, feature) of sentences with their ``examples``.

    hashed: features as 64-bit integers; mod: as buckets below it. lang: whose noun and verb tags support tokens have. A template that the example has
    no value for has no row. Sentences are read with the layers that the templates need.
    """
    templates = list(dict.fromkeys(templates))
    parts = {t: t.parts if isinstance(t, Joint) else (t,) for t in templates}
    units = list(dict.fromkeys(u for p in parts.values() for u in p))
    layers = required_layers(units) | {"words"}
    fields = examples.schema["examples"].dataType.elementType.fieldNames()
    key = [k for k in PLACES if k in fields]
    rows = _indexed(settled(examples.select(*KEYS, "examples", *(c for c in examples.columns if c in layers))), units, lang)

    def gathered(e: Column, k: Column) -> Column:
        ex = lambda name: F.get(F.col(name), k) if name.startswith("_") else e[name] if name in fields else F.lit(None).cast("int" if name in PLACES else "string")
        return F.struct(*(e[c].alias(c) for c in key), *(_evaluate(u, ex).alias(f"u{i}") for i, u in enumerate(units)))

    wide = rows.select(*KEYS, F.inline(F.transform("examples", gathered)))
    # the trie: what two joint templates begin with is one column
    name: dict[tuple, tuple[str, bool]] = {(u,): (f"u{i}", _many(u)) for i, u in enumerate(units)}
    for depth in range(2, max(map(len, parts.values()), default=1) + 1):
        new = {}
        for p in dict.fromkeys(p[:depth] for p in parts.values() if len(p) >= depth):
            (a, a_many), (b, b_many) = name[p[:-1]], name[(p[-1],)]
            name[p] = f"j{len(name)}", a_many or b_many
            new[name[p][0]] = _crossed(F.col(a), a_many, F.col(b), b_many)
        wide = wide.select("*", *(c.alias(n) for n, c in new.items()))
    ones = [F.struct(F.lit(t.name()).alias("template"), F.col(name[p][0]).alias("feature")) for t, p in parts.items() if not name[p][1]]
    some = [_labelled(t, name[p][0]) for t, p in parts.items() if name[p][1]]
    empty = F.array().cast("array<struct<template: string, feature: string>>")
    all_of = [F.array(*ones)] * bool(ones) + [F.coalesce(x, empty) for x in some]
    found = wide.select(*KEYS, *key, F.inline(F.concat(*all_of) if len(all_of) > 1 else all_of[0])).where("feature is not null")
    if hashed or mod:
        value = F.xxhash64("template", "feature")
        found = found.withColumn("feature", F.pmod(value, F.lit(mod)) if mod else value)
    return found


#: Examples of a row, about: the sentence is copied for every so many.
BLOCK = 64

def examples(sents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sentences with an array of their example keys, (p, c) and what other places they have; a long sentence as several rows, by its examples' last place."""
    places = [k for k in (*PLACES, *RULE) if k in pairs.columns]
    by = F.floor(F.coalesce(*(F.col(k) for k in places if k in PLACES[:2][::-1]), F.lit(0)) / BLOCK)
    listed = pairs.groupBy(*KEYS, by.alias("_block")).agg(F.collect_list(F.struct(*places)).alias("examples"))
    return sents.drop("examples").join(listed, KEYS).drop("_block")


def tree_examples(sents: DataFrame, wall: bool = False) -> DataFrame:
    """Sentences with the arcs of their trees as examples, made in the row: p the head, c the token. wall: also those of the wall.

    A long sentence has a row for every so many, which bounds them; rows stay where the sentence is, as a tree has one arc a token.
    """
    n = F.size("parents")
    cut = settled(sents).withColumn("_begin", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(BLOCK))))
    arcs = F.transform(F.slice("parents", F.col("_begin") + 1, BLOCK), lambda p, i: F.struct(p.cast("int").alias("p"), (i + F.col("_begin")).cast("int").alias("c")))
    return cut.withColumn("examples", F.filter(arcs, lambda e: e["p"] >= (-1 if wall else 0))).drop("_begin")


def srl_features(sents: DataFrame, preds: DataFrame | None, pairs: DataFrame | None, sense: Iterable[Template], role: Iterable[Template]) -> DataFrame:
    """Sense templates on predicates (p = c), role templates on pairs, and a bias on every example. preds and pairs None: those of the sentences' arcs in the row."""
    if preds is None:
        of = lambda kept, p: sents.withColumn("examples", F.transform(F.filter("arcs", kept), lambda a: F.struct(p(a).alias("p"), a["c"].alias("c")))).where(F.size("examples") > 0)
        on_preds, on_pairs = of(lambda a: a["p"] == -1, lambda a: a["c"]), of(lambda a: a["p"] >= 0, lambda a: a["p"])
    else:
        on_preds, on_pairs = examples(sents, preds.select(*KEYS, F.col("pred").alias("p"), F.col("pred").alias("c"))), examples(sents, pairs)
    bias = lambda x: x.select(*KEYS, F.explode("examples").alias("e")).select(*KEYS, "e.p", "e.c", F.lit("BIAS").alias("template"), F.lit("BIAS").alias("feature"))
    kind = lambda x, k: x.withColumn("kind", F.lit(k))
    a = kind(extract(on_preds, sense).unionByName(bias(on_preds)), "sense")
    return a.unionByName(kind(extract(on_pairs, role).unionByName(bias(on_pairs)), "role"))


def prune_features(features: DataFrame, min_count: int) -> DataFrame:
    kept = features.groupBy("template", "feature").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count).select("template", "feature")
    return features.join(kept, ["template", "feature"], "left_semi")


def pruned_counts(features: DataFrame, min_count: int) -> DataFrame:
    """(template, feature, n): the features that prune_features keeps, with how often each occurs. Rows needn't be joined with what is kept."""
    return features.groupBy("template", "feature").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def tag_features(toks: DataFrame, order: int = 1, tag: str | None = None) -> DataFrame:
    """For tagging, by windows over tokens: word, affixes and neighbours; with a tag column its n-grams up to ``order`` before. toks: tokens, or sentences with words (and value, the tokens' values to tell) in the row."""
    if "words" in toks.columns:
        at = lambda i, k: F.when(i + k < 0, "BOS").when(i + k >= F.size("words"), "EOS").otherwise(F.get("words", i + k))
        parts = lambda w, i: [(f"w{k:+d}", at(i, k) if k else w) for k in range(-2, 3)] + [(f"pre{n}", affix(w, n)) for n in range(1, 5)] + [(f"suf{n}", affix(w, n, "suffix")) for n in range(1, 5)]
        more = ["value"] if "value" in toks.columns else []
        made = F.transform("words", lambda w, i: F.struct(i.alias("tok"), *(F.get("value", i).alias("value") for _ in more), F.array(*(F.struct(F.lit(n).alias("template"), v.alias("feature")) for n, v in parts(w, i))).alias("x")))
        return toks.select(*KEYS, F.inline(made)).select(*KEYS, "tok", *more, F.inline("x")).where("feature is not null")
    from .tables import by_sentence

    w = by_sentence()
    near = lambda c, k: F.lag(c, -k, "EOS").over(w) if k > 0 else F.lag(c, -k, "BOS").over(w) if k else F.col(c)
    named = [(f"w{k:+d}", near("word", k)) for k in range(-2, 3)]
    named += [(f"pre{n}", affix("word", n)) for n in range(1, 5)] + [(f"suf{n}", affix("word", n, "suffix")) for n in range(1, 5)]
    if "cluster" in toks.columns:
        named += [(f"cl{k:+d}", near("cluster", k)) for k in range(-1, 2)]
    if tag:
        named += [(f"tag-{k}", F.concat_ws("_", *(near(tag, -j) for j in range(k, 0, -1)))) for k in range(1, order + 1)]
    wide = toks.select(*KEYS, "tok", F.array(*(F.struct(F.lit(n).alias("template"), v.alias("feature")) for n, v in named)).alias("x"))
    return wide.select(*KEYS, "tok", F.inline("x")).where("feature is not null")


def triple_features(triples: DataFrame, sents: DataFrame, names: tuple[str, str, str], mod: int = 1 << 19) -> DataFrame:
    """Words and tags of the three tokens of arc triples, alone and together, hashed into ``mod`` buckets."""
    x = triples.join(sents.select(*KEYS, "words", "pos"), KEYS)
    at = lambda layer, n: F.when(F.col(n) < 0, "WALL").otherwise(F.get(layer, F.col(n)))
    tags, words = [at("pos", n) for n in names], [at("words", n) for n in names]
    sets = {"ppp": tags, "wpp": [words[0], *tags[1:]], "pwp": [tags[0], words[1], tags[2]], "ppw": [*tags[:2], words[2]], "pp": [tags[0], tags[2]], "wp": [words[1], tags[2]], "ww": [words[1], words[2]]}
    feats = F.array(*(F.struct(F.lit(k).alias("template"), F.pmod(F.xxhash64(F.lit(k), *v), F.lit(mod)).alias("feature")) for k, v in sets.items()))
    return x.select(*KEYS, *names, F.inline(feats))


def mask_examples(sents: DataFrame, mask: DataFrame) -> DataFrame:
    """Sentences with the arcs that a mask of bitmaps (see masks) keeps as examples, in blocks of tokens."""
    heads = mask.select(*KEYS, "c", masks.heads_of("bits").alias("ps"))
    arcs = F.flatten(F.transform(F.collect_list(F.struct("c", "ps")), lambda t: F.transform(t["ps"], lambda p: F.struct(p.alias("p"), t["c"].alias("c")))))
    listed = heads.groupBy(*KEYS, F.floor(F.col("c") / BLOCK).alias("_block")).agg(arcs.alias("examples")).drop("_block")
    return sents.drop("examples").join(listed, KEYS)


#: Of a triple h, m, s (head or grandparent, middle, last), which words (capital) and tags a template has.
TRIPLE_SETS = {"bias": "", "tags": "hms", "h_s": "hs", "m_s": "ms", "S_h": "Sh", "S_m": "Sm", "H_s": "Hs", "M_s": "Ms", "H_S": "HS", "M_S": "MS"}
TRIPLES = ("grandparent", "sibling", "consecutive", "bigram")


def second_order_features(sents: DataFrame, mask: DataFrame, kinds: Iterable[str] = TRIPLES, mod: int | None = None) -> DataFrame:
    """(keys, kind, h, m, s, template, feature) of the triples of arcs that a mask of bitmaps keeps.

    Kinds: grandparent (h heads m, m heads s), sibling (h heads m and s, m < s), consecutive (siblings without another candidate between), bigram (h heads s, m heads
    the token before s). sents: words and pos. A feature begins with the directions of its arcs; a token that is the wall is WALL. mod: as buckets below it (hash_feature).

    The candidates of a sentence lie in its row as sparse rows, heads by token and tokens by head; triples are made from
    them in blocks of tokens, without a join of arcs.
    """
    heads = mask.select(*KEYS, "c", masks.heads_of("bits").alias("ps"))
    rows = heads.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("c", "ps"))).alias("_t")).select(*KEYS, F.transform("_t", lambda x: x["ps"]).alias("_heads"))
    rows = tree_index.batched(sents.select(*KEYS, "words", "pos").join(rows, KEYS)).withColumn("_kids", tree_index.turned("_heads"))
    n = F.size("_heads")
    rows = rows.withColumn("_begin", F.explode(F.sequence(F.lit(0), n - 1, F.lit(BLOCK))))
    last = F.least(n - 1, F.col("_begin") + BLOCK - 1)
    block = F.sequence(F.col("_begin"), last)
    by_head = F.when(F.col("_begin") == 0, F.concat(F.array(F.lit(-1)), block)).otherwise(block)  # the wall goes with the first block
    triple = lambda h, m, s: F.struct(h.cast("int").alias("h"), m.cast("int").alias("m"), s.cast("int").alias("s"))
    kids = lambda h: F.get("_kids", h + 1)
    made = {
        "grandparent": lambda: F.flatten(F.transform(block, lambda s: F.flatten(F.transform(F.filter(F.get("_heads", s), lambda m: m >= 0), lambda m: F.transform(F.filter(F.get("_heads", m), lambda h: h != s), lambda h: triple(h, m, s)))))),
        "sibling": lambda: F.flatten(F.transform(by_head, lambda h: F.flatten(F.transform(kids(h), lambda m: F.transform(F.filter(kids(h), lambda s: s > m), lambda s: triple(h, m, s)))))),
        "consecutive": lambda: F.flatten(F.transform(by_head, lambda h: F.transform(F.slice(kids(h), 2, F.greatest(F.size(kids(h)) - 1, F.lit(0))), lambda s, i: triple(h, F.get(kids(h), i), s)))),
        "bigram": lambda: F.flatten(F.transform(F.filter(block, lambda s: s > 0), lambda s: F.flatten(F.transform(F.get("_heads", s), lambda h: F.transform(F.get("_heads", s - 1), lambda m: triple(h, m, s)))))),
    }
    each = [rows.select(*KEYS, "words", "pos", F.lit(kind).alias("kind"), made[kind]().alias("ts")) for kind in kinds]
    out = None
    for kind, part in zip(kinds, each):
        features = part.select(*KEYS, "kind", F.inline(F.flatten(F.transform("ts", _triple_maker(kind)))))
        out = features if out is None else out.unionByName(features)
    return out.withColumn("feature", hash_feature(F.concat_ws("|", "template", "feature"), mod)["index"]) if mod else out


def _triple_maker(kind: str) -> Callable[[Column], Column]:
    side = lambda x: F.when(x, "R").otherwise("L")

    def make(t: Column) -> Column:
        h, m, s = t["h"], t["m"], t["s"]
        token = {x: {"lower": F.when(i < 0, "WALL").otherwise(F.get("pos", i)), "upper": F.when(i < 0, "WALL").otherwise(F.get("words", i))} for x, i in (("h", h), ("m", m), ("s", s))}
        flags = {"grandparent": F.concat(side(h < m), side(m < s), side(h < s)), "bigram": F.concat(side(h < s), side(m < s - 1))}.get(kind, F.concat(side(h < m), side(h < s)))
        row = lambda name, what: F.struct(h.alias("h"), m.alias("m"), s.alias("s"), F.lit(name).alias("template"), F.concat_ws("_", flags, *(token[x.lower()]["upper" if x.isupper() else "lower"] for x in what)).alias("feature"))
        return F.array(*(row(name, what) for name, what in TRIPLE_SETS.items()))

    return make


def relation_features(sents: DataFrame, pairs: DataFrame, mentions: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(keys, k, m1, m2, template, feature) of mention pairs: words and heads of both, what lies between and around, types and levels, containment, chunks, the dependency path, and phrases.

    sents: words, and where they are there pos, parents, deprels and chunks (BIO); what needs a missing layer is left out. mentions: start, end, head, type and maybe level.
    nodes: the sentence's constituents; then also the path of symbols between the lowest ones over the heads, and whether these are in one NP, PP or VP. A pair's features are made in its
    sentence's row, for which pairs come together in blocks.
    """
    from .constituents import constituent_path, same_phrase
    from .joins import n_mentions_between

    names = [c for c in ("start", "end", "head", "type", "level") if c in mentions.columns]
    side = lambda m: mentions.select(*KEYS, F.col("m_id").alias(m), *(F.col(c).alias(f"{m}_{c}") for c in names))
    x = n_mentions_between(pairs, mentions).join(side("m1"), [*KEYS, "m1"]).join(side("m2"), [*KEYS, "m2"])
    extra = []
    if nodes is not None:
        order = Window.partitionBy(*KEYS, "start").orderBy(F.col("end") - F.col("start"), F.desc("node"))
        leaves = nodes.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*KEYS, F.col("start").alias("_tok"), F.col("node").alias("_leaf"))
        leaf = lambda m, name: leaves.select(*KEYS, F.col("_tok").alias(f"{m}_head"), F.col("_leaf").alias(name))
        over = x.join(leaf("m1", "a"), [*KEYS, "m1_head"]).join(leaf("m2", "b"), [*KEYS, "m2_head"]).select(*KEYS, "k", "a", "b")
        phrases = constituent_path(nodes, over).join(same_phrase(nodes, over, "NP", "PP", "VP").drop("a", "b"), [*KEYS, "k"]).drop("a", "b")
        x, extra = x.join(phrases, [*KEYS, "k"], "left"), ["path", "same_NP", "same_PP", "same_VP"]
    fields = ["k", "m1", "m2", "n_between", *(f"{m}_{c}" for m in ("m1", "m2") for c in names), *extra]
    listed = x.groupBy(*KEYS, F.floor(F.col("k") / BLOCK).alias("_block")).agg(F.collect_list(F.struct(*fields)).alias("pairs")).drop("_block")
    have = [c for c in ("words", "pos", "parents", "deprels", "chunks") if c in sents.columns]
    rows = tree_index.batched(sents.select(*KEYS, *have).join(listed, KEYS))
    if "parents" in have:
        rows = rows.withColumn("_ways", tree_index.paths("parents", F.transform("pairs", lambda e: F.struct(e["m1_head"].cast("int").alias("a"), e["m2_head"].cast("int").alias("b")))))
        if "chunks" in have:
            rows = rows.withColumn("_chunk", tree_index.chunks("chunks", "parents"))
    made = F.flatten(F.transform("pairs", lambda e, i: _of_pair(e, i, set(rows.columns), set(fields))))
    return rows.select(*KEYS, F.inline(made))


def _of_pair(e: Column, i: Column, layers: set[str], fields: set[str]) -> Column:
    """All features of a pair e, the i-th of its row, as an array of (k, m1, m2, template, feature)."""
    row = lambda template, feature: F.struct(e["k"].alias("k"), e["m1"].alias("m1"), e["m2"].alias("m2"), F.lit(template).alias("template"), feature.cast("string").alias("feature"))
    one = lambda template, feature: F.array(row(template, feature))
    many = lambda template, features: F.transform(features, lambda f: row(template, f))
    also = lambda *parts: F.concat_ws("|", *parts)
    none = F.filter(one("", F.lit("")), lambda _: F.lit(False))
    word = lambda t: _value("word", t)
    inside = lambda m: bag(F.slice("words", e[f"{m}_start"] + 1, e[f"{m}_end"] - e[f"{m}_start"]))
    head1, head2 = word(e["m1_head"]), word(e["m2_head"])
    begin, end = e["m1_head"] + 1, e["m2_head"]
    size = F.greatest(end - begin, F.lit(0))
    gap = F.slice("words", begin + 1, size)
    kind = lambda m: F.coalesce(e[f"{m}_type"], F.lit("NOTYPE"))
    kinds = F.concat_ws("_", kind("m1"), kind("m2"))
    holds = lambda a, b: ((e[f"{a}_start"] <= e[f"{b}_start"]) & (e[f"{b}_end"] <= e[f"{a}_end"])).cast("string")
    heads = F.concat_ws("_", head1, head2)
    low, high = F.least(e["m1_end"], e["m2_end"]), F.greatest(e["m1_start"], e["m2_start"])
    overlap = F.when(holds("m1", "m2") == "true", "M2_IN_M1").when(holds("m2", "m1") == "true", "M1_IN_M2").when(low > high, "PARTIAL").otherwise("NONE")
    out = [
        many("between", bag(F.slice("words", low + 1, F.greatest(high - low, F.lit(0))))), one("overlap", overlap),
        many("word1", inside("m1")), one("words1", F.array_join(inside("m1"), "_")), one("head1", head1), many("word2", inside("m2")), one("words2", F.array_join(inside("m2"), "_")), one("head2", head2), one("heads", heads),
        F.when(size == 0, one("between_none", F.lit("T"))).when(size == 1, one("between_only", F.get(gap, F.lit(0)))).otherwise(F.concat(one("between_first", F.get(gap, F.lit(0))), one("between_last", F.get(gap, size - 1)), many("between_other", F.slice(gap, 2, F.greatest(size - 2, F.lit(0)))))),
        one("before1", word(e["m1_start"] - 1)), one("before1_2", word(e["m1_start"] - 2)), one("after2", word(e["m2_end"])), one("after2_2", word(e["m2_end"] + 1)),
        one("types", kinds), one("n_mentions_between", e["n_between"]), one("n_words_between", size), one("m1_holds", holds("m1", "m2")), one("m2_holds", holds("m2", "m1")),
        one("types+m1_holds", also(kinds, holds("m1", "m2"))), one("types+m2_holds", also(kinds, holds("m2", "m1"))), one("heads+m1_holds", also(heads, holds("m1", "m2"))), one("heads+m2_holds", also(heads, holds("m2", "m1"))),
        many("between_pair", F.transform(F.sequence(F.lit(0), size), lambda j: F.concat_ws("_", word(begin + j - 1), word(begin + j)))), one("between_all", F.array_join(gap, "_")), one("types+between_all", also(kinds, F.array_join(gap, "_"))),
    ]
    if "m1_level" in fields:
        out.append(one("levels", F.concat_ws("_", e["m1_level"], e["m2_level"])))
    if "_ways" in layers:
        way = F.get("_ways", i)
        for m, head in (("m1", head1), ("m2", head2)):
            above = word(F.get("parents", e[f"{m}_head"]))
            out += [one(f"type_{m}+dependent", also(kind(m), above)), one(f"head_{m}+dependent", also(head, above))]
        paths = {"word_path": ("word", "dir")} | ({"pos_path": ("pos", "dir")} if "pos" in layers else {}) | ({"rel_path": (None, "rel")} if "deprels" in layers else {})
        for name, (prop, edge) in paths.items():
            items = _along(way["toks"], way["top"], prop, edge)
            core = F.slice(items, 2, F.greatest(F.size(items) - 2, F.lit(0)))
            out.append(F.when(way["toks"].isNotNull(), F.concat(one(name, F.array_join(items, "_")), F.when(F.size(way["toks"]) >= 3, one(f"types+{name}", also(kinds, F.array_join(core, "_")))).otherwise(none))))
        out.append(one("path_words", F.array_join(F.transform(way["toks"], word), "_")))
        out.append(one("genealogy", trees.kin("parents", e["m1_head"], e["m2_head"], way)))
        if "path" in fields:
            lowest = word(F.coalesce(F.get(way["toks"], way["top"]), F.lit(-1)))
            out.append(one("phrase_path+lowest", also(e["path"], lowest)))
    if "path" in fields:
        out.append(F.when(e["path"].isNotNull(), one("phrase_path", e["path"])))
        out += [one(f"types+same_{p}", also(kinds, e[f"same_{p}"].cast("string"))) for p in ("NP", "PP", "VP")]
    if "_chunk" in layers:
        c1, c2 = (F.get("_chunk.of", e[f"{m}_head"]) for m in ("m1", "m2"))
        n = F.size("_chunk.heads")
        head = lambda c: F.when(c < 0, "BOS").when(c >= n, "EOS").otherwise(F.get("words", F.get("_chunk.heads", c)))
        apart = F.greatest(c2 - c1 - 1, F.lit(0))
        inner = F.filter(F.sequence(c1 + 1, c1 + F.greatest(apart, F.lit(1))), lambda c: c <= c1 + apart)
        labels, named = F.transform(inner, lambda c: F.get("_chunk.labels", c)), F.transform(inner, head)
        out += [
            F.when(apart == 0, one("chunk_none", F.lit("T"))).when(apart == 1, one("chunk_only", head(c1 + 1))).otherwise(F.concat(one("chunk_first", head(c1 + 1)), one("chunk_last", head(c2 - 1)), many("chunk_other", F.slice(named, 2, F.greatest(apart - 2, F.lit(0)))))),
            one("chunk_before1", head(c1 - 1)), one("chunk_before1_2", head(c1 - 2)), one("chunk_after2", head(c2 + 1)), one("chunk_after2_2", head(c2 + 2)), one("chunk_path", F.array_join(labels, "_")),
            F.when(apart <= 2, one("chunk_path_heads", F.array_join(F.zip_with(labels, named, lambda a, b: F.concat_ws(":", a, b)), "_"))), one("chunk_heads", F.array_join(named, "_")), one("types+chunk_heads", also(kinds, F.array_join(named, "_"))),
        ]
    return F.filter(F.concat(*(F.coalesce(x, none) for x in out)), lambda r: r["feature"].isNotNull())


#: Levels of word features, each with what those before it have.
LEVELS = ("head_only", "head_type", "head_type_on_path", "head_type_between", "full")


def relation_word_features(sents: DataFrame, pairs: DataFrame, mentions: DataFrame, level: str = "full") -> DataFrame:
    """(k, tok, feature): for each word of the sentence that is something to the pair of mentions, what it is."""
    m = lambda side, place: mentions.select(*KEYS, F.col("m_id").alias(side), F.col("head").alias(place), F.coalesce("type", F.lit("NOTYPE")).alias(f"_{place}"))
    x = pairs.select(*KEYS, "k", "m1", "m2").join(m("m1", "p"), [*KEYS, "m1"]).join(m("m2", "c"), [*KEYS, "m2"])
    x = x.select(*KEYS, "k", "p", "c", F.concat_ws("_", "_p", "_c").alias("kinds"))
    listed = x.groupBy(*KEYS, F.floor(F.col("k") / BLOCK).alias("_block")).agg(F.collect_list(F.struct("k", "p", "c", "kinds")).alias("examples")).drop("_block")
    return _word_features(sents.drop("examples").join(listed, KEYS), ["k"], level, lambda e: e["kinds"])


def role_word_features(sents: DataFrame, pairs: DataFrame | None, level: str = "full", bits: int = 6) -> DataFrame:
    """(p, c, tok, feature): for each word that is something to the pair, what it is; clusters cut at ``bits`` (4 or 6) stand for types. pairs None: those of the sentences' arcs in the row."""
    if pairs is None:
        of = F.transform(F.filter("arcs", lambda a: a["p"] >= 0), lambda a: F.struct(a["p"].alias("p"), a["c"].alias("c")))
        rows = settled(sents.withColumn("examples", of).where(F.size("examples") > 0))
    else:
        rows = examples(sents, pairs)
    cut = lambda i: F.substring(F.get("clusters", i), 1, bits)
    return _word_features(rows, ["p", "c"], level, lambda e: F.concat_ws("_", cut(e["p"]), cut(e["c"])))


def _word_features(rows: DataFrame, keys: list[str], level: str, kinds: Callable[[Column], Column]) -> DataFrame:
    """Made in the sentence's row from the tokens a pair points at, so a pair costs what it has, not the sentence."""
    depth = LEVELS.index(level)
    if depth >= 2:
        pairs = F.transform("examples", lambda e: F.struct(e["p"].cast("int").alias("a"), e["c"].cast("int").alias("b")))
        rows = tree_index.batched(rows).withColumn("_ways", tree_index.paths("parents", pairs))

    def of(e: Column, i: Column) -> Column:
        p, c, kind = e["p"].cast("int"), e["c"].cast("int"), kinds(e)
        row = lambda tok, feature: F.struct(*(e[k].alias(k) for k in keys), tok.cast("int").alias("tok"), feature.alias("feature"))
        typed = lambda name: F.concat(F.lit(f"{name}-"), kind)
        both = lambda toks, name: F.flatten(F.transform(toks, lambda t: F.array(row(t, F.lit(name)), row(t, typed(name)))))
        out = [F.array(row(p, F.lit("head1")), row(c, F.lit("head2")))]
        if depth >= 1:
            out.append(F.array(row(p, typed("head1")), row(c, typed("head2"))))
        if depth >= 2:
            out.append(both(F.coalesce(F.get("_ways", i)["toks"], F.array().cast("array<int>")), "on_path"))
        if depth >= 3:
            low, high = F.least(p, c), F.greatest(p, c)
            out.append(both(F.filter(F.sequence(low, high), lambda t: (t > low) & (t < high)), "between"))
        if depth >= 4:
            out.append(F.array(*(row(at + d, F.lit(f"{name}{d:+d}")) for name, at in (("head1", p), ("head2", c)) for d in (-2, -1, 1, 2))))
        return F.filter(F.concat(*out), lambda r: (r["tok"] >= 0) & (r["tok"] < F.size("words")) & r["feature"].isNotNull())

    return rows.select(*KEYS, F.inline(F.flatten(F.transform("examples", of))))
