import subprocess

import pytest

from tessera import boundary
from tessera.operators import render


def test_texts(spark):
    files = spark.createDataFrame([("a/b.py",), ("c.py",)], "path string")
    assert render.file_tree(files).first().text == "a/\n  b.py\nc.py"
    rows = spark.createDataFrame([("f", "function", 3), ("C", "class", 1)], "name string, symbol_type string, start_line int")
    assert render.symbol_list(rows).first().text == "- **C** (class) line 1\n- **f** (function) line 3"
    assert render.symbol_list(rows.limit(0)).first().text == "No symbols."
    assert render.table(rows, ["name", "start_line"], ["start_line"]).first().text == "| name | start_line |\n|---|---|\n| C | 1 |\n| f | 3 |"


def test_diagrams(spark):
    between = spark.createDataFrame([("a", "b", 2)], "from string, to string, n long")
    text = render.component_diagram(spark.createDataFrame([("a",), ("b",)], "component string"), between).first().diagram
    assert text == 'flowchart TD\n    a["a"]\n    b["b"]\n    a -->|2| b'
    layers = render.layer_diagram(spark.createDataFrame([("a", "x.py"), ("b", "y.py")], "layer string, file string"), between.select("from", "to"))
    classes = render.class_diagram(spark.createDataFrame([("C", ["f", "g"])], "class string, methods array<string>"))
    pages = spark.createDataFrame([("p.md", "text")], "path string, content string")
    both = spark.createDataFrame([("p.md", 0, "layers", layers.first().diagram), ("p.md", 1, "classes", classes.first().diagram), ("p.md", 2, "flow", "flowchart LR\n  a[")], "path string, pos int, kind string, diagram string")
    content = render.append_diagrams(pages, both).first().content
    assert content.count("```mermaid") == 2 and "subgraph a" in content and "+g()" in content


def test_git_and_models(tmp_path):
    for args in (("init", "-q", "-b", "main"), ("config", "user.email", "a@example.com"), ("config", "user.name", "a")):
        subprocess.run(["git", *args], cwd=tmp_path, check=True)
    (tmp_path / "a.py").write_text("x")
    subprocess.run(["git", "add", "."], cwd=tmp_path, check=True)
    subprocess.run(["git", "commit", "-qm", "m"], cwd=tmp_path, check=True)
    path = str(tmp_path)
    assert boundary.tracked_files(path) == ["a.py"] and boundary.file_at(path, boundary.head(path), "a.py") == "x" and boundary.default_branch(path) == "main"
    with pytest.raises(boundary.GitError) as e:
        boundary.clone(str(tmp_path / "none"), str(tmp_path / "to"))
    assert e.value.kind == "not_found"
    model = boundary.Canned(["a", "b"])
    assert [model.generate("q") for _ in range(3)] == ["a", "b", "b"]
    assert boundary.provider({"K2": "x"}, [("K1", "p1", "m1"), ("K2", "p2", "m2")]) == ("p2", "m2")
