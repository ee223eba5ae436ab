from verslog import demo


def test_walk(spark, tmp_path):
    assert demo.run(spark, f"{tmp_path}") == {
        "last_seq": 1000,
        "conflict": True,
        "forward": ["account:alice", "account:bob"],
        "reverse": ["user:0999", "user:0998"],
        "backup": 1005,
        "restored": 1002,
        "follower": 1002,
    }
