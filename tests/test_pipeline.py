"""End to end over text documents with the stub provider."""

import json
from pathlib import Path

import pytest

from folioflow import cli
from folioflow.config import Profile, Settings, list_profiles, read_env, resolve_base_url
from folioflow.operators.providers import StubProvider
from folioflow.plans.pipeline import Job, Pipeline
from folioflow.prompts import fill, load, patient_context
from folioflow.sources import cache, files
from folioflow.streaming.incremental import run_available


@pytest.fixture
def folders(tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    (source / "one_2024-02-03.pdf").write_text("Doppler study\nseen 2024-02-03 and more text\fsecond page 3/2/2024 with enough text\fthird page without any date at all")
    (source / "sub" / "two b.pdf").write_text("REFUSE a page that is refused at first, 2023-01-01")
    (source / "bill.pdf").write_text("fatura numero 1 com texto suficiente")
    (source / "empty.pdf").write_bytes(b"")
    (source / "broken.pdf").write_bytes(b"\xff\xfe\xff")
    return source, out


def test_run_twice_then_one_page(spark, folders):
    source, out = folders
    pipeline = Pipeline(spark, Job(str(source), str(out)))
    assert {r["doc_stem"]: r["pages"] for r in pipeline.dry_run().collect()} == {"one_2024-02-03": 3, "two b": 1, "bill": 1, "empty": 0, "broken": 0}
    assert not out.exists()
    report = pipeline.process()
    assert {r["doc_stem"]: (r["status"], r["pages"]) for r in report.documents.collect()} == {
        "one_2024-02-03": ("processed", 3), "two b": ("processed", 1), "bill": ("skipped", 0), "empty": ("failed", 0), "broken": ("failed", 0),
    }
    assert report.issues.where("doc_stem not in ('empty', 'broken')").count() == 0
    page = (out / "one_2024-02-03" / "one_2024-02-03.002.md").read_text()
    assert page.startswith("---\nexam_date: '2024-02-03'\n") and "category: ultrasound" in page and page.endswith("enough text\n")
    assert "prompt_variant: transcription_system_alt1" in (out / "two b" / "two b.001.md").read_text()
    summary = (out / "one_2024-02-03" / "one_2024-02-03.summary.md").read_text()
    assert "page:" not in summary and "Summary " in summary
    assert pipeline.frontmatter_issues().count() == 0
    known = {r["cache_key"]: r["exam_type"] for r in cache.read(spark, pipeline.job.cache).collect()}
    assert known["doppler study"] == "ultrasound"
    assert {r[0] for r in Pipeline(spark, Job(str(source), str(out))).plan().select("doc_stem").collect()} == {"empty", "broken"}
    before = {p.name for p in (out / "one_2024-02-03").iterdir() if not p.name.startswith(".")}
    Pipeline(spark, Job(str(source), str(out))).process(document="one_2024-02-03", page=2)
    assert {p.name for p in (out / "one_2024-02-03").iterdir() if not p.name.startswith(".")} == before
    assert (out / "one_2024-02-03" / "one_2024-02-03.summary.md").read_text().count("Summary") == 1


def test_regenerate_keeps_incomplete(spark, folders):
    source, out = folders
    Pipeline(spark, Job(str(source), str(out))).process()
    (out / "two b" / "two b.001.md").unlink()
    (out / "one_2024-02-03" / "one_2024-02-03.summary.md").unlink()
    done = Pipeline(spark, Job(str(source), str(out))).regenerate()
    assert {tuple(r) for r in done.collect()} == {("one_2024-02-03", 3)}
    assert (out / "one_2024-02-03" / "one_2024-02-03.summary.md").exists() and (out / "two b" / "two b.summary.md").exists()


def test_stray_copies_do_not_mix(spark, folders):
    """A copy of a page file in another folder is no page of its document; what is listed is read, by its path."""
    source, out = folders
    Pipeline(spark, Job(str(source), str(out))).process()
    (out / "backup").mkdir()
    (out / "backup" / "two b.001.md").write_text("---\ntitle: Stray\n---\n\nstray text\n")
    listed = files.output_files(spark, f"file://{out}")
    found = files.stored_records(listed.where("kind = 'page' and doc_stem = 'two b'")).collect()
    assert [r["transcription"] for r in found] == ["a page that is refused at first, 2023-01-01"]
    plan = files.read_markdown(listed.where("kind = 'page'"))._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "MapInArrow" in plan
    assert files.stored_images(listed.where("kind = 'image' and doc_stem = 'two b'")).count() == 1


def test_samples_mode(spark, folders):
    source, out = folders
    Pipeline(spark, Job(str(source), str(out), n_extractions=3)).process(document="one_2024-02-03.pdf")
    assert "confidence: 1.0" in (out / "one_2024-02-03" / "one_2024-02-03.001.md").read_text()


def test_same_stem_twice(spark, folders):
    source, out = folders
    (source / "sub" / "bill.pdf").write_text("x")
    with pytest.raises(ValueError, match="bill"):
        Pipeline(spark, Job(str(source), str(out))).plan()


def test_stream_second_run_is_empty(spark, folders, tmp_path):
    source, _ = folders
    seen = []
    done = spark.createDataFrame([("bill",)], "doc_stem string")
    run = lambda: run_available(spark, str(source), str(tmp_path / "checkpoint"), lambda: done, lambda batch, _: seen.extend(r["doc_stem"] for r in batch.select("doc_stem").collect()))
    assert run() == 1 and set(seen) == {"one_2024-02-03", "two b", "broken"}
    assert run() == 0


def test_cli(spark, folders, tmp_path, monkeypatch, capsys):
    source, out = folders
    profiles = tmp_path / "profiles"
    profiles.mkdir()
    (profiles / "me.yaml").write_text(f"paths:\n  input_path: {source}\n  output_path: {out}\nbirth_date: 1980-01-02\nfull_name: A B\n")
    (profiles / "_template.yaml").write_text("name: no")
    (profiles / "other.json").write_text(json.dumps({"name": "Other"}))
    (tmp_path / ".env").write_text("EXTRACT_MODEL_ID=m\nSELF_CONSISTENCY_MODEL_ID=m\nSUMMARIZE_MODEL_ID=m\nOPENROUTER_API_KEY='k'\n")
    monkeypatch.chdir(tmp_path)
    assert list_profiles(profiles) == ["me", "other"]
    assert Profile.find(profiles, "me").birth_date == "1980-01-02"
    assert cli.main(["--list-profiles"]) == 0 and capsys.readouterr().out == "me\nother\n"
    assert cli.main(["-p", "me", "--page", "1"]) == 2
    assert cli.main(["-p", "me", "-d", "one_2024-02-03"], StubProvider, spark) == 0
    assert Path(out, "one_2024-02-03", "one_2024-02-03.003.jpg").exists() and Path(out, "logs", "info.log").exists()
    assert cli.main(["-p", "me", "--resummarize", "-d", "one_2024-02-03.pdf"], StubProvider, spark) == 0
    assert cli.main([], StubProvider, spark) == 1  # the other profile has no paths


def test_settings(tmp_path):
    env = {"EXTRACT_MODEL_ID": "e", "SELF_CONSISTENCY_MODEL_ID": "s", "SUMMARIZE_MODEL_ID": "z", "OPENROUTER_API_KEY": "k", "MAX_WORKERS": "many"}
    got = Settings.from_env(env)
    assert (got.max_workers, got.n_extractions, got.validation_model) == (1, 1, "e")
    over = got.overridden(Profile("p", model="m", workers=4), workers=2)
    assert (over.extract_model, over.validation_model, over.max_workers) == ("m", "e", 2)
    with pytest.raises(ValueError, match="SUMMARIZE_MODEL_ID"):
        Settings.from_env({k: v for k, v in env.items() if k != "SUMMARIZE_MODEL_ID"})
    assert resolve_base_url("http://localhost:1/v1", True) == "http://host.docker.internal:1/v1"
    (tmp_path / ".env").write_text("A=1\n")
    (tmp_path / ".env.x").write_text("A=2\nB='q'\n")
    (tmp_path / ".env.local").write_text("B=3\n")
    assert read_env(tmp_path) == {"A": "1", "B": "3"} and read_env(tmp_path, "x") == {"A": "2", "B": "3"}


def test_prompts_and_cache(spark, tmp_path):
    assert patient_context(None, None, "pt") == "" and "1980" in patient_context(None, "1980-01-02", None)
    assert fill("summary_first", n=1, exam_list="{n}", transcriptions="t").startswith("1 exams:\n{n}")
    with pytest.raises(FileNotFoundError):
        load("none")
    assert "- 0.7 to 0.9: " in load("score_system") and "- 1: " in load("score_system")
    assert "- endoscopy: a look inside" in load("standardize_system") and '"Chest X-ray"' in load("standardize_system")
    path = str(tmp_path / "names.json")
    assert cache.read_json(spark, path).count() == 0
    cache.write_json(spark.createDataFrame([("b", "other", "B"), ("a", "imaging", "Á")], "cache_key string, exam_type string, standardized_name string"), path)
    assert list(json.loads(Path(path).read_text())) == ["a", "b"] and cache.read_json(spark, path).count() == 2
    assert cache.read_json(spark, f"file://{path}").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["names.json"]
    Path(path).write_text("{broken")
    assert cache.read_json(spark, path).count() == 0


def test_logs_in_folders_and_stores(tmp_path):
    from pyarrow import fs

    from folioflow.sinks import logs

    for clear, lines in ((True, 2), (False, 4)):
        log = logs.set_up(f"file://{tmp_path}/a", clear=clear)
        log.info("one")
        log.error("two")
        logs.set_up(None)
        assert len((tmp_path / "a" / "info.log").read_text().splitlines()) == lines and len((tmp_path / "a" / "error.log").read_text().splitlines()) == lines // 2
    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    for clear, lines in ((True, 2), (False, 4), (True, 2)):
        handler = logs.StoreHandler(store, "other.log", clear)
        for level in (20, 40):
            handler.emit(logs.logging.LogRecord("x", level, "", 0, "text", None, None))
        handler.close()
        assert len((tmp_path / "other.log").read_text().splitlines()) == lines


def test_http_provider(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from folioflow.operators import providers
    from folioflow.operators.http_provider import HttpProvider

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            message = {"content": '```json\n{"transcription": "the text of the page"}\n```'}
            if "tools" in body:
                message = {"tool_calls": [{"function": {"arguments": '{"is_exam": false, "exam_date": "2024-01-02"}'}}]}
            reply = json.dumps({"choices": [{"message": message}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    settings = Settings("e", "c", "s", "v", "m", api_key="k", base_url=f"http://127.0.0.1:{server.server_port}/v1")
    provider = HttpProvider(settings)
    assert providers.classify_document(provider, [b"x"]) == {"is_exam": False, "exam_name_raw": None, "exam_date": "2024-01-02", "facility_name": None, "physician_name": None, "department": None}
    assert providers.transcribe_with_retry(provider, b"x") == ("the text of the page", "transcription_system", 1)
    assert [(b["model"], b["temperature"], b["max_tokens"]) for b in seen] == [("c", 0.1, 1024), ("e", 0.1, 16384), ("v", 0.0, 10)]
    server.shutdown()
    assert providers.classify_document(HttpProvider(settings, timeout=0.2), [b"x"])["is_exam"] is True
