import re

import numpy as np
import pyarrow as pa

from sparkhop.llm import words


def test_words_and_hashes_do_not_depend_on_the_batch():
    texts = ["a b  c", None, "", "\tx\n", "é ü\x0bé", " ", "a b"]
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (_, data, offs), = words.slices(whole)
    w = words.Words(data, offs)
    got = [[data[w.start[k] : w.end[k]].tobytes().decode() for k in range(a, b)] for a, b in zip(w.first, w.first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    h = w.hashes()
    apart = np.concatenate([words.Words(d, o).hashes() for _, d, o in words.slices(whole, chunk=1)])
    assert (h == apart).all() and h[0] == h[w.first[6]] and len(set(h.tolist())) == 6
    assert words.Words(*words.buffers(pa.array([], pa.string()))).hashes().size == 0


def test_grams_stay_in_their_text():
    data, offs = words.buffers(pa.array(["a b c", "b c", "c"]))
    w = words.Words(data, offs)
    g, at = words.grams(w.hashes(), w.doc, 2)
    assert at.tolist() == [0, 1, 3] and g[1] == g[2] != g[0]


def test_slices_of_sliced_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "bb", "cc dd", None])], names=["text"]).slice(1)
    parts = list(words.slices(batch, chunk=2))
    assert sum(p.num_rows for p, _, _ in parts) == 3 and b"".join(d.tobytes() for _, d, _ in parts) == b"bbcc dd"
