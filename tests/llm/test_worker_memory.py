"""Worker processes are reused: what one operator keeps there goes when another's task begins."""

import gc
import weakref

import public_tokenizers
import pyarrow as pa

from quarry.llm import packing, partenum, suffix_dedup

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["some words of a text that is long enough to hold a few shingles", "Other words, other text"]


def test_encoder_stays_for_tasks_of_its_operator():
    first = packing.encoder_of(PATH)
    ids = first.encode([t.encode() for t in TEXTS])
    assert packing.encoder_of(PATH) is first
    assert first.encode([t.encode() for t in TEXTS]) == ids


def test_encoder_goes_with_the_next_operator():
    ids = packing.encoder_of(PATH).encode([t.encode() for t in TEXTS])
    for task, columns in ((partenum.signature_rows(partenum.signatures, 4), {"text": TEXTS}),
                          (suffix_dedup.anchor_rows, {"did": [1, 2], "text": [t * 20 for t in TEXTS]})):
        held = weakref.ref(packing.encoder_of(PATH))
        assert held() is not None
        rows = sum(b.num_rows for b in task(iter([pa.RecordBatch.from_pydict(columns)])))
        gc.collect()
        assert rows > 0
        assert held() is None
    assert packing.encoder_of(PATH).encode([t.encode() for t in TEXTS]) == ids
