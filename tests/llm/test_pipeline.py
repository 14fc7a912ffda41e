"""The pipeline's stages, each on what the one before kept, against the operators and brute force."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from lumenrow.llm import bpe, common, language, minhash, mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, tmp_path):
    """(name, input rows, output frame) of each stage, written and read again between them."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, "unused").write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    done = stages(spark, docs, tmp_path)
    assert [name for name, _, _ in done] == ["language", "quality", "near_dedup", "mixing", "tokens"]
    for _, _, after in done[:-1]:
        assert after.columns == COLUMNS
    by = {name: (before, after) for name, before, after in done}
    before, after = by["language"]
    assert ids(after) == ids(language.identify(before).filter(f"lang_pred <> 'und' AND score >= {corpus_pipeline.SURE}"))
    before, after = by["quality"]
    assert ids(after) == ids(quality.quality_verdicts(before).filter("kept"))
    before, after = by["near_dedup"]
    assert ids(after) == ids(minhash.near_duplicates(before).filter("kept"))
    before, after = by["mixing"]
    assert ids(after) == ids(mixing.mix_sources(before).filter("sampled"))
    assert 0 < after.count() < before.count()
    before, after = by["tokens"]
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: theirs.encode_ordinary(r.text) for r in before.collect()}
    got = after.collect()
    assert len(got) == len(want)
    for r in got:
        raw = b"".join(x.to_bytes(4, "little") for x in want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(raw).hexdigest())


def test_good_documents_stay(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    good = docs.join(labels, "doc_id", "left_semi").select(COLUMNS)
    kept = corpus_pipeline.language_stage(spark, good, "unused")
    assert kept.count() == good.count()
    passed = corpus_pipeline.quality_stage(spark, good, "unused")
    base = quality.quality_verdicts(good).filter("not base_failed")
    assert passed.count() == base.count()


def test_odd_rows_and_columns(spark, tmp_path):
    prose = "the quick brown fox jumps over the lazy dog while seven wizards quietly box " * 3
    text = prose + " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1, "x", "y"), (1, text, "en", "a", 1, "x", "y"), (None, text + " more", None, None, None, None, None), (3, None, "en", "a", 0, "x", "y"), (4, "", "en", "a", 0, "x", "y"), (5, "12 34 !!", "en", "a", 0, "x", "y"), (6, text * 300, "en", "b", 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, lang_pred string")
    done = stages(spark, docs, tmp_path)
    assert done[0][2].columns == docs.columns
    assert ids(done[0][2]) == [1, 1, 6, None]
    assert ids(done[1][2]) == ids(done[2][2]) == [1, 1, None]  # 6 repeats itself; rows of one id stay together
    empty = stages(spark, docs.limit(0), tmp_path / "empty")
    assert [after.count() for _, _, after in empty] == [0] * 5


def test_tables_are_written_with_few_processes(spark, tmp_path):
    """A ``chmod`` for each part and its attempt's folder, and some for the table; none for checksum files and markers."""
    jvm, parts = spark._jvm, 8
    frame = spark.range(80).repartition(parts)
    recording = jvm.jdk.jfr.Recording()
    recording.enable("jdk.ProcessStart")
    recording.start()
    after = common.cut(frame, "few")
    recording.stop()
    at = jvm.java.nio.file.Path.of(str(tmp_path / "few.jfr"), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
    recording.dump(at)
    recording.close()
    started = [e.getString("command") for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(at)]
    own = [c for c in started if c.startswith("chmod") and "/few-" in c]
    assert len(own) <= 2 * parts + 6
    assert sorted(r.id for r in after.collect()) == list(range(80))
    common.discard(after)
