"""JSON and YAML documents, templates, and subsumption."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactum.plans import emit, subsume, template
from pactum.sources import jsondoc, yamldoc

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=12)


@given(VALUES)
@settings(max_examples=200, deadline=None)
def test_canonical_json_round_trips(x):
    text = emit.compact(x)
    assert json.loads(text) == x and emit.compact(json.loads(text)) == text
    nodes = jsondoc.read_text(text, "doc")
    assert nodes[0][4] != "error" and len({n[0] for n in nodes}) == len(nodes)


@given(st.dictionaries(st.text(min_size=1, max_size=6, alphabet="abz_-:# .1"), VALUES, max_size=4))
@settings(max_examples=200, deadline=None)
def test_yaml_round_trips(x):
    if x:
        assert yamldoc.read(emit.yaml(x)) == x


def test_lexemes_and_order():
    got = [(n[0], n[4], n[5]) for n in jsondoc.read_text('{"b": 1.0, "a": [2, 2.50, null], "odd name": "\\n"}', "d")]
    assert got == [("d", "object", None), ("d.b", "float", "1.0"), ("d.a", "array", None), ("d.a[0]", "int", "2"), ("d.a[1]", "float", "2.50"), ("d.a[2]", "null", "null"), ('d["odd name"]', "string", "\n")]
    assert ("d.a", "duplicate") in [(n[0], n[4]) for n in jsondoc.read_text('{"a": 1, "a": 2}', "d")]


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a" 1}', "1 2", "{1: 2}", "[1 2]", "tru", '"\t"', "01", "{,}", ":", "]"])
def test_malformed(text):
    assert jsondoc.read_text(text, "d")[0][4] == "error"


def test_yaml_forms():
    doc = "# head\na: &x\n  b: [1, 2.5, 'it''s', {c: ~}]\nlist:\n- p: 1\n  q: two # note\n- - 3\n  - 4\ntext: |\n  one\n   two\nfold: >-\n  a\n  b\nagain: *x\nempty: {}\n"
    assert yamldoc.read(doc) == {"a": {"b": [1, 2.5, "it's", {"c": None}]}, "list": [{"p": 1, "q": "two"}, [3, 4]], "text": "one\n two\n", "fold": "a b", "again": {"b": [1, 2.5, "it's", {"c": None}]}, "empty": {}}
    for bad in ("a: 1\na: 2", "a: !t 1", "<<: 1", "---\na: 1\n---\nb: 2", "1: a", "a: *none", "\ta: 1", "a: [1"):
        with pytest.raises(yamldoc.Refused):
            yamldoc.read(bad)


def test_templates():
    doc = {"name": "web", "ports": [80, 443], "env": {"A": "1", "B": "2"}, "n": 3}
    show = lambda t: template.render(t, doc)
    assert show("{{ name }}:{{ ports[1] }}") == "web:443"
    assert show("{% for p in ports %}{{ loop.index }}={{ p }}{% if !loop.last %},{% endif %}{% endfor %}") == "1=80,2=443"
    assert show("{% for k, v in env %}{{ k + v }} {% endfor %}") == "A1 B2 "
    assert show("a {%- if n > 2 && name == \"web\" %} b {%- elif true %} c {% else %} d {% endif %}") == "a b"
    assert show("{% set x = n * 2 %}{{ if x > 5 then x else 0 }}{# gone #}{% raw %}{{ y }}{% endraw %}") == "6{{ y }}"
    assert show("{{ env?.C ?? \"none\" }} {{ std.string.join(std.map.keys(env), \"-\") }} {{ -7 / 2 }} {{ -7 % 2 }}") == "none A-B -3 -1"
    for bad in ("{{ nope }}", "{% if n %}", "{{ 1 / 0 }}", "{{ ports[9] }}", "{% what %}"):
        with pytest.raises(template.TemplateError):
            show(bad)


R, L, P = (lambda a, b, o=False: ("range", a, b, o, "int")), (lambda *x: ("lits", frozenset(x))), (lambda k: ("prim", k))


@pytest.mark.parametrize(
    ("a", "b", "yes"),
    [
        (R(1, 5), R(0, 9), True),
        (R(0, 10), R(0, 10, True), False),
        (R(0, 10, True), R(0, 9), True),
        (R(1, 3), L(1, 2, 3), True),
        (R(1, 3), P("int"), True),
        (P("int"), R(1, 3), False),
        (L("a", "b"), ("pattern", "[ab]"), True),
        (L("a", 1), ("union", P("string"), P("int")), True),
        (P("bool"), L(True, False), True),
        (("array", R(1, 2), 1, 3), ("array", P("int"), 0, 5), True),
        (("array", P("int"), None, None), ("array", P("int"), 0, 5), False),
        (("record", {"a": ("required", R(1, 2))}, False), ("record", {"a": ("optional", P("int")), "b": ("optional", P("int"))}, False), True),
        (("record", {"a": ("optional", P("int"))}, False), ("record", {"a": ("required", P("int"))}, False), False),
        (("record", {"a": ("required", P("int"))}, False), ("map", P("string"), P("int")), True),
        (R(5, 1), L("x"), True),
        (P("string"), ("any",), True),
        (L(1), L(1.0), False),
    ],
)
def test_subsumption(a, b, yes):
    assert subsume.subsumes(a, b) is yes


def test_recursive_and_discriminated():
    names = {"Tree": ("record", {"v": ("required", P("int")), "kids": ("optional", ("array", ("named", "Tree"), None, None))}, False), "Wide": ("record", {"v": ("required", ("union", P("int"), P("string"))), "kids": ("optional", ("array", ("named", "Wide"), None, None))}, False)}
    assert subsume.subsumes(("named", "Tree"), ("named", "Wide"), names) and not subsume.subsumes(("named", "Wide"), ("named", "Tree"), names)
    arm = lambda *ks: ("record", {"kind": ("required", L(*ks))}, False)
    assert subsume.discriminant({"A": arm("a"), "B": arm("b", "c")}) == "kind"
    with pytest.raises(TypeError, match="E4014"):
        subsume.discriminant({"A": arm("a"), "B": arm("a")})
    assert subsume.breaking_changes({"a": ("optional", R(1, 5))}, {"a": ("optional", R(1, 3)), "b": ("required", P("int"))}) == ["a", "b"]
