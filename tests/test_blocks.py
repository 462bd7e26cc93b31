from chainloom.queries import api
from tests.oracle import DATA, views


def test_every_block_is_returned(spark, rows):
    """Blocks without predecessor or another field are there, the first block of a chain among them."""
    q = api.QUERIES
    every = rows(q["sink_k1_blocks"](spark, DATA).select("hash"))
    hashes = views().execute(f"SELECT DISTINCT {api._H('hash')} AS h FROM block WHERE h IS NOT NULL ORDER BY h").fetchall()
    assert every == hashes
    assert q["g33_chain_blocks"](spark, DATA).where("previousblockhash is null").count() > 0
