"""Links, locks and embedding: what is not confirmed is refused."""

import pytest

from pactum.sources import package as P


def test_link():
    a = P.Module("a", {"X": 1, "hidden": 2}, exports=["X"], roots=["in_a"])
    b = P.Module("b", {"Y": 3}, exports=["Y"], imports={"a": ["X"]})
    assert P.link([b, a])["b"] == {"Y": 3, "X": 1}
    for bad, code in (
        ([P.Module("c", {}, imports={"a": ["hidden"]}), a], "E3005"),
        ([P.Module("c", {}, imports={"none": []})], "E3003"),
        ([P.Module("c", {}, imports={"d": []}), P.Module("d", {}, imports={"c": []})], "E3004"),
        ([a, P.Module("c", {}, roots=["in_a"])], "E3007"),
        ([a, P.Module("c", {"X": 5}, imports={"a": ["X"]})], "E3006"),
        ([a, a], "E3001"),
    ):
        with pytest.raises(P.LinkError, match=code):
            P.link(bad)


def test_lock(tmp_path):
    (tmp_path / "net").mkdir()
    (tmp_path / "net" / "m.py").write_text("X = 1\n")
    pins = {"net": "1.2.0"}
    locked = P.lock(tmp_path, pins)
    P.verify(tmp_path, pins, locked)
    (tmp_path / "net" / "m.py").write_text("X = 2\n")
    with pytest.raises(P.LinkError, match="E3012"):
        P.verify(tmp_path, pins, locked)
    with pytest.raises(P.LinkError, match="E3010"):
        P.lock(tmp_path, {"net": "^1.2"})


def test_embedding():
    small, wide = ("range", 1, 5, False, "int"), ("prim", "int")
    P.embedding({"$parent": wide}, {"$parent": small})
    with pytest.raises(P.LinkError, match="E4094"):
        P.embedding({"$parent": small}, {"$parent": wide})
    with pytest.raises(P.LinkError, match="E4090"):
        P.embedding({"$parent": small}, {})
