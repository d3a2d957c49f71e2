from notewright.llm import encoder as E
from notewright.llm.queries import VOCABULARY


def test_a_small_memory_gives_the_same_ids_and_stays_small():
    texts = [f"word{i} other{i * 7 % 400} and  {i}" for i in range(600)]
    small, usual = E.encoder(VOCABULARY, 50), E.encoder(VOCABULARY)
    assert [list(small.encode(t)) for t in texts] == [list(usual.encode(t)) for t in texts]
    assert len(small.chunks) <= 50 and len(small.chunks.older) <= 50 < len(usual.chunks)
