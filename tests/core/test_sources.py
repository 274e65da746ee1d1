from __future__ import annotations

from assetgraph.plans import catalog
from assetgraph.sources import files, markdown
from assetgraph.streaming.findings import watch

SKILL = """---
id: skill.review
owner: "team-a"
requires_context: [ctx.one, ctx.two]
optional_context:
  - ctx.three
---
# Title #

See [one](contexts/one.md).

```sh
# not a heading
[no](link)
```

## Next
"""


def test_tree_and_catalog(spark, tmp_path):
    (tmp_path / "skills/review").mkdir(parents=True)
    (tmp_path / "contexts").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "skills/review/SKILL.md").write_text(SKILL)
    (tmp_path / "contexts/one.md").write_text("---\nid: ctx.one\n---\nbody\n")
    (tmp_path / "node_modules/x.md").write_text("x")
    (tmp_path / "bin.dat").write_bytes(b"a\x00b")
    (tmp_path / "big.md").write_text("y" * 5000)
    tree = files.read_tree(spark, str(tmp_path), ["node_modules"], most_bytes=4096)
    got = {r.path: (r.state, r.classification) for r in tree.collect()}
    assert got == {"skills/review/SKILL.md": ("parsed", "text"), "contexts/one.md": ("parsed", "text"), "node_modules/x.md": ("excluded", None), "bin.dat": ("parsed", "binary"), "big.md": ("oversize", None)}
    parsed = markdown.parse(tree.where("classification = 'text'"))
    skill = parsed.where("path like '%SKILL.md'").first()
    assert skill.metadata == {"id": ["skill.review"], "owner": ["team-a"], "requires_context": ["ctx.one", "ctx.two"], "optional_context": ["ctx.three"]}
    assert [(h.line, h.depth, h.title) for h in skill.headings] == [(8, 1, "Title"), (17, 2, "Next")]
    assert [(x.line, x.label, x.target) for x in skill.links] == [(10, "one", "contexts/one.md")]
    assets = {r.id: (r.kind, r.owner) for r in catalog.assets(parsed).collect()}
    assert assets == {"skill.review": ("skill", "team-a"), "ctx.one": ("context", None)}
    assert sorted((r.src, r.dst, r["kind"]) for r in catalog.edges(parsed).collect()) == [("skill.review", "ctx.one", "requires"), ("skill.review", "ctx.three", "optional"), ("skill.review", "ctx.two", "requires")]


def test_fixpoint(spark):
    tree = spark.createDataFrame([("a", ["b"]), ("b", ["c", "a"]), ("c", []), ("d", ["a"])], "path string, refs array<string>")
    seed = spark.createDataFrame([("a",)], "path string")
    assert {r.path: r.depth for r in files.reference_fixpoint(seed, tree).collect()} == {"a": 0, "b": 1, "c": 2}


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, 'x\ntoken = "abcdefghijklmnop"'), (2, "nothing"), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    watch(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r.doc_id, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2)]
