"""Store, indexing, search, command line, server and streaming on real repositories."""

import io
import json
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from siltstone import cli, doctor
from siltstone.functions.embedders import HashingEmbedder
from siltstone.operators import keyword
from siltstone.plans import indexing, searching
from siltstone.server import Server
from siltstone.sources import repository
from siltstone.sources.config import Chunking, Config, Embedding
from siltstone.store import IndexStore, StoreError, head_key
from siltstone.streaming.ingest import ingest, read_stream

CHUNK = "repo_root string, branch string, file_path string, chunk_index int, content string, language string, start_line int, end_line int, annotation string, signature string, embedding array<float>"


def chunks(spark, rows, repo="/r"):
    """rows: branch, path, index, content, vector."""
    return spark.createDataFrame([(repo, b, p, i, c, "go", 1, 1, f"[go] [{p}]", "", v) for b, p, i, c, v in rows], CHUNK)


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"), 4)


def axis(i):
    return [float(j == i) for j in range(4)]


def folders(store, name):
    return {p.split("/")[1] for ps in store.manifest["parts"][name].values() for p in ps}


def test_scopes_of_a_batch_are_written_at_once(spark, store):
    rows = [(b, f"f{i}.go", 0, f"v{i}", axis(i)) for b in ("a", "b", "") for i in range(3)]
    store.upsert_text_only(chunks(spark, rows).drop("embedding"))
    assert len(folders(store, "chunks")) == 1
    store.upsert_text_only(chunks(spark, [("b", "f1.go", 0, "new", axis(0)), ("c", "f1.go", 0, "v9", axis(0))]).drop("embedding"))
    got = {b: sorted((r["file_path"], r["content"]) for r in store.all_chunks("/r", b).collect()) for b in ("a", "b", "", "c")}
    old = [(f"f{i}.go", f"v{i}") for i in range(3)]
    assert got == {"a": old, "": old, "b": [old[0], ("f1.go", "new"), old[2]], "c": [("f1.go", "v9")]}
    store.vacuum()
    assert {b: store.count_chunks("/r", b) for b in got} == {"a": 3, "": 3, "b": 3, "c": 1}


def test_chunks_keep_the_place_that_they_bring(spark, store):
    rows = chunks(spark, [("a", "t.go", 0, f"v{i}", axis(i)) for i in range(3)]).withColumn("_at", -F.monotonically_increasing_id())
    store.upsert_text_only(rows.drop("embedding"))
    assert [r["content"] for r in store.all_chunks("/r", "a").collect()] == ["v0"]


def test_postings_of_all_scopes_are_made_at_once(spark, store, monkeypatch):
    store.upsert_text_only(chunks(spark, [(b, f"f{i}.go", 0, t, None) for b in ("a", "b") for i, t in enumerate(("alpha beta alpha", "beta", "--"))] + [("c", "x.go", 0, "--", None)]).drop("embedding"))
    scanned = {b: [(r["file_path"], r["content"], r["score"]) for r in store.search_keyword("/r", b, "beta", 5).collect()] for b in ("a", "b", "c")}
    made, postings = [], keyword.postings
    monkeypatch.setattr(keyword, "postings", lambda *a: made.append(1) or postings(*a))
    store.rebuild_keyword_index()
    assert len(made) == 1 and len(folders(store, "postings")) == 1
    assert {b: len(x) for b, x in scanned.items()} == {"a": 2, "b": 2, "c": 0}
    for b, want in scanned.items():
        got = [(r["file_path"], r["content"], r["score"]) for r in store.search_keyword("/r", b, "beta", 5).collect()]
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    store.vacuum()
    assert store.search_keyword("/r", "a", "alpha", 5).count() == 1


def test_upsert_and_dedup(spark, store):
    store.upsert_chunks(chunks(spark, [("a", "t.go", 0, "func alpha() {}", axis(0)), ("a", "t.go", 1, "func beta() {}", axis(1)), ("b", "t.go", 0, "func alpha() {}  \n", axis(2))]), "m")
    assert store.read("embeddings").count() == 2 and store.read("chunks").count() == 3 and store.count_chunks("/r", "a") == 2
    kept = {r["chunk_text"]: r["embedding"] for r in store.latest().collect()}
    store.upsert_chunks(chunks(spark, [("a", "t.go", 1, "func alpha() {}", axis(3))]), "m")  # the first vector stays, the mapping moves
    assert {r["chunk_text"]: r["embedding"] for r in store.latest().collect()} == kept
    assert [r["content"] for r in store.all_chunks("/r", "a").collect()] == ["func alpha() {}"] * 2
    assert store.delete_orphans() == 1 and store.read("embeddings").count() == 1


def test_models_and_dimensions(spark, store):
    one = chunks(spark, [("a", "t.go", 0, "x", axis(0))])
    store.upsert_text_only(one.drop("embedding"))
    assert store.model_ids() == [] and store.search_keyword("/r", "a", "x", 5).count() == 1 and store.search_vector("/r", "a", axis(0), 5).count() == 0
    store.upsert_chunks(one, "m1")  # texts without vectors give way
    assert store.model_ids() == ["m1"] and store.search_vector("/r", "a", axis(0), 5).count() == 1
    version = store.version
    with pytest.raises(StoreError, match="refusing to mix"):
        store.upsert_chunks(chunks(spark, [("a", "u.go", 0, "y", axis(0))]), "m2")
    with pytest.raises(StoreError, match="dimensions"):
        store.upsert_chunks(chunks(spark, [("a", "u.go", 0, "y", [1.0])]), "m1")
    with pytest.raises(StoreError, match="no embedding"):
        store.upsert_mappings(chunks(spark, [("a", "u.go", 0, "z", axis(0))]), "m1")
    assert store.version == version
    store.upsert_mappings(chunks(spark, [("b", "w.go", 0, "x", axis(0))]), "m1")
    assert store.count_chunks("/r", "b") == 1
    assert 0 < store.dead_ratio() < 1
    store.compact_vectors()
    assert store.dead_ratio() == 0


def test_scoped_search(spark, store):
    rows = [("other", f"d{i}.go", 0, f"distractor bobbin {i}", axis(0)) for i in range(10)] + [("main", "target.go", 0, "func bobbin() {}", [0.9, 0.1, 0.0, 0.0])]
    store.upsert_chunks(chunks(spark, rows), "m")
    assert [r["file_path"] for r in store.search_vector("/r", "main", axis(0), 1).collect()] == ["target.go"]
    for _ in range(2):  # scanned, then from the index
        got = store.search_keyword("/r", "main", "bobbin", 10).collect()
        assert [r["file_path"] for r in got] == ["target.go"] and got[0]["score"] < 0 and got[0]["rank"] == 0
        store.rebuild_keyword_index()
    assert store.search_vector("/r", "main", axis(0), 0).count() == 0 and store.search_keyword("/r", "main", "  ", 5).count() == 0
    with pytest.raises(StoreError):
        store.search_vector("/r", "main", [1.0], 3)
    store.delete_files("/r", "main", ["target.go"])
    assert store.search_keyword("/r", "main", "bobbin", 10).count() == 0 and store.read("embeddings").count() == 11


def test_scores_of_scan_and_index(spark, store):
    store.upsert_chunks(chunks(spark, [("main", f"f{i}.go", 0, f"alpha {'beta ' * i}gamma-{i}", axis(i % 4)) for i in range(6)]), "m")
    one = [tuple(r) for r in store.search_keyword("/r", "main", "alpha beta", 10).collect()]
    store.rebuild_keyword_index()
    two = [tuple(r) for r in store.search_keyword("/r", "main", "alpha beta", 10).collect()]
    assert [r[:3] for r in one] == [r[:3] for r in two] and len(one) == 5
    assert [r[9] for r in one] == pytest.approx([r[9] for r in two])


def test_the_last_row_of_a_batch_wins(spark, store):
    rows = [("main", "a.go", 0, f"text {i * 7 % 10}", None) for i in range(10)]
    store.upsert_text_only(chunks(spark, rows).drop("embedding"))
    assert [r["content"] for r in store.all_chunks("/r", "main").collect()] == ["text 3"]


def test_trim_prune_and_lists(spark, store):
    store.upsert_text_only(chunks(spark, [("main", "tail.go", i, f"c{i}", None) for i in range(3)] + [("main", "a.go", 0, "x", None), ("feature", "g.go", 0, "x", None)]).drop("embedding"))
    store.trim_file("/r", "main", "tail.go", 2)
    assert store.count_chunks("/r", "main") == 3
    with pytest.raises(StoreError):
        store.trim_file("/r", "main", "tail.go", -1)
    assert [r[0] for r in store.list_files("/r", "main").collect()] == ["a.go", "tail.go"]
    counts = spark.createDataFrame([("tail.go", 1)], "file_path string, n long")
    store.prune_tails("/r", "main", counts)
    assert store.count_chunks("/r", "main") == 2
    store.prune_tails("/r", "main", counts, unseen_go=True)
    assert [r[0] for r in store.list_files("/r", "main").collect()] == ["tail.go"] and store.list_branches("/r") == ["feature", "main"]


def test_copy_branch_edges_and_state(spark, store):
    store.upsert_text_only(chunks(spark, [("main", "a.go", 0, "x", None), ("main", "b.go", 0, "y", None)]).drop("embedding"))
    store.set_file_hashes("/r", "main", spark.createDataFrame([("a.go", "h")], "file_path string, file_hash string"))
    edge = spark.createDataFrame([("s", "t", "/r", "main"), ("s", "t", "/r", "main"), ("s", "t", "/o", "main")], "source_hash string, target_hash string, repo_root string, branch string")
    store.upsert_edges(edge)
    store.upsert_edges(edge)
    assert (store.count_edges("/r", "main"), store.count_edges("/o", "main"), store.count_edges("/r", "x")) == (1, 1, 0)
    store.copy_branch("/r", "main", "feature")
    assert store.count_chunks("/r", "feature") == 2 and store.count_edges("/r", "feature") == 1 and store.file_hashes("/r", "feature").count() == 1
    with pytest.raises(StoreError):
        store.copy_branch("/r", "main", "feature")
    store.delete_branch("/r", "feature")
    with pytest.raises(StoreError, match="files"):
        store.copy_branch("/r", "main", "feature")
    store.set_state(head_key("/r", "empty"), "c1")
    store.set_state("other", "v")
    assert store.state("nothing") == "" and store.list_branches("/r") == ["empty", "main"] and store.state_keys("head_commit:") == [head_key("/r", "empty")]
    store.delete_state("other")
    reopened = IndexStore(spark, store.path, 4)
    assert reopened.state("other") == "" and reopened.count_chunks("/r", "main") == 2


def test_edges_by_file(spark, store):
    store.upsert_text_only(chunks(spark, [("main", "a.go", 0, "x", None), ("main", "b.go", 0, "y", None)]).drop("embedding"))
    by = {r["file_path"]: r["content_hash"] for r in store.read("chunks").collect()}
    store.upsert_edges(spark.createDataFrame([(by["a.go"], by["b.go"], "/r", "main"), (by["b.go"], by["a.go"], "/r", "main")], "source_hash string, target_hash string, repo_root string, branch string"))
    near = store.neighbours("/r", "main", spark.createDataFrame([(by["a.go"],)], "content_hash string")).collect()
    assert [(r["file_path"], r["score"]) for r in near] == [("b.go", 0.0)]
    store.delete_edges_by_file("/r", "main", "a.go")
    assert [r["source_hash"] for r in store.read("edges").collect()] == [by["b.go"]]


def test_many_hashes_and_writers(spark, store):
    store.upsert_chunks(chunks(spark, [("main", "a.go", 0, "x", axis(0))]), "m")
    h = store.read("chunks").first()["content_hash"]
    asked = spark.createDataFrame([(h,), (h,)] + [(f"missing{i}",) for i in range(699)], "content_hash string")
    got = {r["content_hash"]: r["there"] for r in store.has_hashes(asked, "m").collect()}
    assert len(got) == 700 and [k for k, v in got.items() if v] == [h] and not store.has_hashes(asked, "m2").where("there").count()
    other = IndexStore(spark, store.path, 4)
    store.set_state("k", "1")
    with pytest.raises(StoreError, match="faster"):
        other.set_state("k", "2")
    before = store.bytes()
    store.set_file_hashes("/r", "main", None)
    assert store.vacuum() >= 0 and store.bytes() < before + 10_000 and IndexStore(spark, store.path, 4).count_chunks("/r", "main") == 1


# Repositories ---------------------------------------------------------------------------------------------


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


def write(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text) if isinstance(text, bytes) else p.write_text(text)


def commit(root, message="c"):
    git(root, "add", "-A")
    git(root, "commit", "-qm", message, "--allow-empty")


@pytest.fixture
def repo(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", str(tmp_path / "no-config"))
    root = tmp_path / "repo"
    root.mkdir()
    git(root, "init", "-q", "-b", "main")
    write(root, auth_dot_go="package auth\n\n// Login checks.\nfunc Login(name string) error {\n\treturn ValidateToken(name)\n}\n\nfunc ValidateToken(t string) error {\n\treturn nil\n}\n", web__handler_dot_go="package web\n\nfunc HandleRequest(r string) {\n\tLogin(r)\n\tValidateToken(r)\n}\n", notes_dot_md="Hello words of the notes\n")
    commit(root)
    return root


CONFIG = Config(embedding=Embedding(provider="hashing", model="hashing", dimensions=16), chunking=Chunking(200, 1))


@pytest.fixture
def indexed(spark, repo, tmp_path):
    s = IndexStore(spark, str(tmp_path / "repo-index"), 16)
    indexing.index_repo(s, str(repo), CONFIG, HashingEmbedder(16))
    return s


def test_walk_and_diff(repo):
    write(repo, x_dot_log="l", sub__y_dot_log="l", sub___dot_gitignore="*.tmp\n", sub__z_dot_tmp="t", vendor__v_dot_go="v", _dot_gitignore="*.log\nvendor/\n", bin_dot_dat=b"a\0b", big_dot_txt="x" * (500 * 1024 + 1), fits_dot_txt="x" * (500 * 1024), delete_dot_me="d", rename_dot_me="r" * 50)
    (repo / "link.md").symlink_to(repo / "notes.md")
    found = repository.walk_files(repo)
    assert found == [".gitignore", "auth.go", "delete.me", "fits.txt", "notes.md", "rename.me", "sub/.gitignore", "web/handler.go"]
    assert "notes.md" not in repository.walk_files(repo, ["*.md"])
    commit(repo)
    old = repository.head_commit(repo)
    write(repo, new_dot_txt="n", notes_dot_md="changed\n")
    (repo / "delete.me").unlink()
    (repo / "rename.me").rename(repo / "renamed.me")
    commit(repo)
    added, modified, deleted = repository.diff_files(repo, old, repository.head_commit(repo))
    assert (added, modified, deleted) == (["new.txt", "renamed.me"], ["notes.md"], ["delete.me", "rename.me"])
    assert repository.diff_files(repo, "0" * 40, old) == ([p for p in found if p != "link.md"], [], [])
    git(repo, "checkout", "-q", "--detach")
    assert repository.current_branch(repo) == repository.head_commit(repo)[:12] and repository.list_branches(repo) == ["main"]
    assert repository.repo_root(repo / "sub") == str(repo)
    with pytest.raises(repository.NotARepository):
        repository.repo_root("/")


def test_index_and_search(spark, repo, indexed):
    root = str(repo)
    assert indexed.state(head_key(root, "main")) == repository.head_commit(repo) and indexed.count_edges(root, "main") == 3
    s = searching.Searcher(indexed, HashingEmbedder(16))
    got = s.search(root, "main", "ValidateToken", "keyword", 2)
    assert got.mode == "keyword" and got.results and not {r["content_hash"] for r in got.results} & {r["content_hash"] for r in got.related}
    hybrid = s.search(root, "main", "Login checks", "", 3)
    assert hybrid.mode == "hybrid" and "Login" in hybrid.results[0]["content"] and [r["score"] for r in hybrid.results] == sorted((r["score"] for r in hybrid.results), reverse=True)
    assert len(s.search(root, "main", "words", "semantic", 1, include_related=False).results) == 1
    with pytest.raises(ValueError):
        s.search(root, "main", "  ")
    warned = []
    fallback = searching.Searcher(indexed, None, warn=warned.append).search(root, "main", "Login", "hybrid")
    assert fallback.mode == "keyword" and warned and fallback.results
    with pytest.raises(RuntimeError):
        searching.Searcher(indexed, None).search(root, "main", "Login", "semantic")
    text = searching.human(hybrid)
    assert text.startswith("[1] ") and ("--- Related ---" in text) == bool(hybrid.related)
    shaped = json.loads(searching.as_json("q", hybrid))
    assert list(shaped) == ["query", "mode", "results", "related"] and set(shaped["results"][0]) == {"file_path", "start_line", "end_line", "language", "score", "content", "chunk_index"}
    assert all("\t" in x for x in searching.compact(hybrid).splitlines() if x)


def test_index_again_changes_nothing(spark, repo, indexed):
    before = sorted(map(str, indexed.all_chunks(str(repo), "main").collect()))
    n = indexed.read("embeddings").count()
    indexing.index_repo(indexed, str(repo), CONFIG, HashingEmbedder(16))
    assert sorted(map(str, indexed.all_chunks(str(repo), "main").collect())) == before and indexed.read("embeddings").count() == n


def test_update(spark, repo, indexed):
    root = str(repo)
    write(repo, notes_dot_md="Goodbye words\n", fresh_dot_md="a new file\n", copy_dot_md="a new file\n")
    (repo / "web/handler.go").unlink()
    commit(repo)
    assert indexing.update_repo(indexed, root, CONFIG, HashingEmbedder(16)) == {"added": 2, "modified": 1, "deleted": 1}
    assert [r[0] for r in indexed.list_files(root, "main").collect()] == ["auth.go", "copy.md", "fresh.md", "notes.md"]
    s = searching.Searcher(indexed, None)
    assert [r["file_path"] for r in s.search(root, "main", "Goodbye", "keyword").results] == ["notes.md"] and not s.search(root, "main", "Hello", "keyword").results
    whole = {(r["file_path"], r["content"]) for r in indexed.all_chunks(root, "main").collect()}
    indexing.index_repo(indexed, root, CONFIG, HashingEmbedder(16))
    assert {(r["file_path"], r["content"]) for r in indexed.all_chunks(root, "main").collect()} == whole
    write(repo, _dot_gitignore="copy.md\n")  # without a commit: bytes count, not commits
    assert indexing.update_repo(indexed, root, CONFIG, HashingEmbedder(16)) == {"added": 1, "modified": 0, "deleted": 1}
    with pytest.raises(indexing.NotIndexed):
        indexing.update_repo(indexed, root, CONFIG, HashingEmbedder(16), branch="nobody")


def test_a_file_that_shrinks_below_the_least(spark, repo, tmp_path):
    s, config = IndexStore(spark, str(tmp_path / "i"), 16), Config(chunking=Chunking(200, 4))
    indexing.index_repo(s, str(repo), config, None)
    assert s.list_files(str(repo), "main").where("file_path = 'notes.md'").count() == 1 and s.model_ids() == []
    write(repo, notes_dot_md="tiny\n")
    indexing.update_repo(s, str(repo), config, None)
    assert s.list_files(str(repo), "main").where("file_path = 'notes.md'").count() == 0


def test_gc(spark, repo, indexed):
    root = str(repo)
    git(repo, "checkout", "-q", "-b", "feature")
    write(repo, only_dot_md="only in the feature\n")
    commit(repo)
    indexed.copy_branch(root, "main", "feature")
    indexed.set_state(head_key(root, "feature"), "x")
    indexing.update_repo(indexed, root, CONFIG, HashingEmbedder(16))
    git(repo, "checkout", "-q", "main")
    git(repo, "branch", "-D", "feature")
    n = indexed.read("embeddings").count()
    assert indexing.collect_garbage(indexed, root, dry_run=True)["branches"] == 1 and indexed.list_branches(root) == ["feature", "main"]
    done = indexing.collect_garbage(indexed, root)
    assert done["branches"] == 1 and done["orphans"] == 1 and indexed.read("embeddings").count() == n - 1 and indexed.list_branches(root) == ["main"]
    assert indexed.file_hashes(root, "feature").count() == 0 and searching.Searcher(indexed, HashingEmbedder(16)).search(root, "main", "Login").results
    indexed.set_state(head_key(root, "zero"), "y")
    assert indexing.collect_garbage(indexed, root)["branches"] == 1


def test_staleness_and_scaffold(repo):
    assert [indexing.staleness(m, n) for m, n in (("hybrid", 0), ("hybrid", 10), ("keyword", 10), ("hybrid", 11), ("hybrid", 50))] == [
        ("", False), ("index is stale (10 files changed), updating it first", True), ("index is stale: 10 files changed", False), ("index is stale: 11 files changed", False), ("index is stale: 50 files changed", False),
    ]
    assert "significantly" in indexing.staleness("hybrid", 51)[0]
    assert indexing.scaffold(str(repo)) == [".gitignore", ".siltstone/config.toml"] and indexing.scaffold(str(repo)) == []
    assert (repo / ".gitignore").read_text() == ".siltstone/\n"


def test_command_line(spark, repo, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(repo)
    (repo / ".siltstone").mkdir()
    (repo / ".siltstone/config.toml").write_text('[embedding]\nprovider = "hashing"\ndimensions = 16\n[chunking]\nmin_chunk_tokens = 1\n')
    assert cli.run(["search", "Login"]) == 2 and cli.run(["update"]) == 2
    assert cli.run(["init"]) == 0 and "indexed main" in capsys.readouterr().out
    assert cli.run(["Login", "checks", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["mode"] == "hybrid"
    assert cli.run(["search", "zzzznothing", "--keyword"]) == 1 and cli.run(["search", "x", "--keyword", "--semantic"]) == 3 and cli.run(["search", "x", "--json", "--compact"]) == 3
    write(repo, late_dot_md="lately arrived\n")
    commit(repo)
    capsys.readouterr()
    assert cli.run(["search", "lately", "--compact", "--no-related"]) == 0
    said = capsys.readouterr()
    assert "updating it first" in said.err and "late.md" in said.out
    assert cli.run(["status"]) == 0 and "[up to date]" in capsys.readouterr().out
    assert cli.run(["gc", "--dry-run"]) == 0 and "0 branches would be pruned" in capsys.readouterr().out
    assert cli.run(["gc"]) == 0 and cli.run(["version"]) == 0 and cli.run(["doctor"]) == 0
    git(repo, "checkout", "-q", "-b", "feature")
    assert cli.run(["init", "--reuse-from", "main"]) == 0 and cli.run(["search", "Login", "--semantic"]) == 0
    assert cli.run(["init", "--reuse-from", "nobody"]) == 1
    assert cli.rewrite(["--top-k", "3", "some words"]) == ["search", "--top-k", "3", "some words"] and cli.rewrite(["status"]) == ["status"] and cli.rewrite([]) == []
    monkeypatch.chdir("/")
    assert cli.run(["search", "x"]) == 3 and cli.run(["status"]) == 1


def test_doctor(repo, monkeypatch):
    out = io.StringIO()
    assert not doctor.run(str(repo), repo / "none.toml", out) and "[FAIL] config" in out.getvalue() and "skipped" in out.getvalue()
    p = repo / "c.toml"
    p.write_text('[embedding]\nprovider = "hashing"\n')
    out = io.StringIO()
    assert doctor.run(str(repo), p, out) and out.getvalue().count("[ok] parser") == 11
    monkeypatch.delenv("VOYAGE_API_KEY", raising=False)
    p.write_text("")
    out = io.StringIO()
    assert not doctor.run(str(repo), p, out) and "[FAIL] api key" in out.getvalue()


def test_server(spark, repo, indexed):
    server = Server(indexed, HashingEmbedder(16), CONFIG, str(repo))
    ask = lambda method, **params: server.answer({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert ask("initialize")["result"]["serverInfo"]["name"] == "siltstone" and {t["name"] for t in ask("tools/list")["result"]["tools"]} == {"search_codebase", "index_status", "reindex"}
    call = lambda name, **a: ask("tools/call", name=name, arguments=a)["result"]
    assert json.loads(call("search_codebase", query="Login", limit=2)["content"][0]["text"])["results"]
    assert call("search_codebase", query=" ")["isError"] and call("search_codebase", query="x", mode="odd")["isError"]
    status = json.loads(call("index_status")["content"][0]["text"])
    assert status["chunk_count"] > 0 and status["edge_count"] == 3 and status["last_commit"] == repository.head_commit(repo)
    write(repo, notes_dot_md="Goodbye\n")
    assert json.loads(call("reindex")["content"][0]["text"]) == {"status": "ok", "reindexed": True}
    assert json.loads(call("search_codebase", query="Goodbye", mode="keyword")["content"][0]["text"])["results"]
    assert "error" in ask("tools/call", name="nothing") and "error" in ask("nothing") and server.answer({"method": "notifications/initialized"}) is None
    sink = io.StringIO()
    server.serve(io.StringIO('{"jsonrpc":"2.0","id":7,"method":"ping"}\n\nnot json\n'), sink)
    assert [json.loads(x).get("id") for x in sink.getvalue().splitlines()] == [7, None]


def test_streaming(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, a_dot_md="first file of words\n", b_dot_go="package p\n\nfunc Alpha() int { return 1 }\n")
    start = lambda: ingest(read_stream(spark, str(folder)), store, "/r", "main", str(tmp_path / "cp"), chunking=Chunking(50, 1)).awaitTermination(120)
    start()
    assert {r["file_path"].rsplit("/", 1)[1] for r in store.all_chunks("/r", "main").collect()} == {"a.md", "b.go"}
    time.sleep(1)
    write(folder, c_dot_md="third file\n")
    start()
    assert store.list_files("/r", "main").count() == 3 and store.search_keyword("/r", "main", "third", 5).count() == 1
    assert store.file_hashes("/r", "main").count() == 3 and store.state(head_key("/r", "main")) == "stream-0"
