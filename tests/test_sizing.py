from bootloom.plans.sizing import partitions_for, partitions_over


def test_partitions():
    assert [partitions_for(n, 100) for n in (0, 1, 100, 101, 1000)] == [1, 1, 1, 2, 10]


def test_a_run_is_spread_over_the_cores():
    assert [partitions_over(mb << 20, 12) for mb in (0, 10, 40, 200, 900, 12_800)] == [1, 1, 3, 12, 12, 50]
