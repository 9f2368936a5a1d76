import brute
import pytest

from gaugeworks.llm.mixing import mix_documents


def mixed(table, rows, **options):
    return [tuple(r) for r in mix_documents(table(rows), **options).collect()]


@pytest.mark.parametrize("slots", [1 << 20, 64, 5])
def test_targets_and_shares(table, corpus, slots):
    got = mixed(table, corpus, slots=slots)
    sizes = {}
    for _, text, _, source, _ in corpus:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    wanted = brute.targets(sizes)
    assert brute.by_id([(r[0], r[1], r[2]) for r in got]) == brute.by_id(
        [(i, s, len(brute.words(t))) for i, t, _, s, _ in corpus]
    )
    for doc_id, source, size, source_size, target, taken in got:
        assert source_size == sizes[source] and target == pytest.approx(wanted[source])
        assert 0 <= taken <= 3 * size
    for source, target in wanted.items():
        assert sum(r[5] for r in got if r[1] == source) == pytest.approx(target, abs=1)


def test_reruns_and_partitions_do_not_matter(table, corpus):
    one = brute.by_id(mixed(table, corpus))
    again = brute.by_id([tuple(r) for r in mix_documents(table(corpus, 7)).collect()])
    assert one == again


def test_capped_sources_and_empty_tables(table):
    rows = [(1, "a b c d", "en", "a", 1), (2, "w " * 1000, "en", "b", 1), (3, "", "en", "c", 1)]
    got = {r[0]: r for r in mixed(table, rows)}
    assert got[1][4:] == (12.0, 12) and got[2][4:] == (992.0, 992) and got[3][4:] == (0.0, 0)
    assert mixed(table, []) == []
    assert mixed(table, [(1, None, "en", "a", 0)]) == [(1, "a", 0, 0, 0.0, 0)]


def test_the_main_path_is_native(table, corpus):
    plan = mix_documents(table(corpus))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
