import random
import shutil
import string

import corpus_pipeline
import pyarrow as pa
from fleetscope.llm import token_files


def test_odd_texts_are_encoded_as_the_library_does():
    rng, parts = random.Random(3), ["a", "é", "the", "'s", "'", ".", " ", "\n", "1", "ɏ", "ɐ", "漢", "́", "!?", "\t", " ", "Z", "ﬁ", "²", "\xad", "\x85"]
    texts = ["dogs' it's 'twas don't.", "a.\nB c,\nD", "a\n", "\na", "a b\n", "...\n...", "ʰa ɐ. ɐb!", "ªº µ. ſ"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4_000)]
    for own in (token_files.Encoder(token_files.default_tokenizer(), words=50), token_files.Encoder(token_files.default_tokenizer())):
        assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_on_both_sides_of_a_line_break_are_remembered():
    own = token_files.Encoder(token_files.default_tokenizer())
    texts = ["the end.\nStart of\nit", "x " + "line\n" * 20_000 + "end", "a\t\nb c", "(a\n\rb) c", "q ɐ\nb's\n'twas"]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert {"end.", "\x00Start", "of", "\x00it"} <= own.known.keys()


def test_many_words_stay_known():
    words = {"".join(w) for w in zip(*[iter(random.Random(5).choices(string.ascii_lowercase, k=6 * 350_000))] * 6)}
    own, every = token_files.Encoder(token_files.default_tokenizer()), sorted(words)
    own.encode(["x " + " ".join(every[k : k + 2_000]) for k in range(0, len(every), 2_000)])
    assert not words - own.known.keys() - own.elder[0].keys()


def test_workers_of_the_pipeline_give_their_words_back(spark, tmp_path, monkeypatch):
    own = shutil.copy(token_files.default_tokenizer(), tmp_path / "tokenizer.json")
    monkeypatch.setattr(token_files, "default_tokenizer", lambda: str(own))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string").repartition(8)
    assert corpus_pipeline.write_tokens(spark, docs, None).count() == 200

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(str(own) in token_files._encoders)] * batch.num_rows, pa.int32())], ["held"])

    assert {r.held for r in docs.mapInArrow(held, "held int").collect()} == {0}
