"""Trees of files, signed deliveries as a stream, and imports of frameworks."""

import hashlib
import hmac
import json

from hunkflow.operators import detectors
from hunkflow.sources import trees
from hunkflow.sources.commits import Store
from hunkflow.streaming import deliveries
from tests.test_diffs import diff, run


def test_source_files(spark, tmp_path):
    root = tmp_path / "a b+c"
    for name, content in {
        "src/a.ts": b"export const a = 1\n", "z.kt": b"fun z() {}", "node_modules/x/i.js": b"no", "pkg/node_modules/y.js": b"no", "Build/out.js": b"no", "README.md": b"no", "src/dist/ok.py": b"x = '\xff'", "src/empty.go": b"",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    rows = {r.path: r for r in trees.source_files(spark, str(root)).collect()}
    assert set(rows) == {"src/a.ts", "z.kt", "src/dist/ok.py"}
    assert (rows["src/a.ts"].lang, rows["z.kt"].lang, rows["src/a.ts"].content, rows["src/dist/ok.py"].size) == ("javascript", None, "export const a = 1\n", 7)
    assert sorted(r.path for r in trees.source_files(spark, str(root), 2).collect()) == ["src/a.ts", "src/dist/ok.py"]
    deliveries.apply_changes(trees.as_changes(trees.source_files(spark, str(root)), "r"), str(tmp_path / "index"))
    assert {r.file for r in deliveries.read_index(spark, str(tmp_path / "index")).collect()} == set(rows)


def test_ingest(spark, tmp_path):
    secret = b"k"
    sign = lambda body: "sha256=" + hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()
    good = [(f"d{i}", json.dumps({"action": "opened", "number": i})) for i in range(3)]
    rows = [{"delivery": d, "signature": sign(b), "body": b} for d, b in good] * 2
    rows += [{"delivery": "u", "body": "{}"}, {"delivery": "f", "signature": "sha256=00", "body": "{}"}, {"delivery": "j", "signature": sign("no"), "body": "no"}]
    (tmp_path / "in").mkdir()
    path, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    for n, part in enumerate([rows, [{"delivery": "d9", "signature": sign("{}"), "body": "{}"}]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        raw = spark.readStream.schema(deliveries.RAW).json(str(tmp_path / "in"))
        deliveries.ingest(raw, secret, path, checkpoint).awaitTermination()
    store = Store(spark, path)
    assert sorted((r.delivery, r.number) for r in store.read("events").collect()) == [("d0", 0), ("d1", 1), ("d2", 2), ("d9", None)]
    assert {(r.delivery, r.reason) for r in store.read("rejected").collect()} == {("u", "unsigned"), ("f", "signature"), ("j", "body")}
    assert store.manifest()["batches"] == {"ingest": 1}


def test_invented_imports(spark):
    lines = ["+import { describe, toBeMagic, it as test2 } from 'vitest'", "+import { render } from '@testing-library/react'", "-import { x } from 'jest'", "+import { expect } from \"jest\"", "+import { y } from './y'", "+import { } from 'jest'"]
    assert run(spark, detectors.invented_imports, diff("src/a.ts", *lines)) == [(0, 1, "medium", "toBeMagic"), (0, 2, "medium", "render")]
