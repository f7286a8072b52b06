"""The queries of this subpackage, and SQL for those that SQL can express."""

from pagemill.llm import bpe, chat, exact, langid, near, omh, packing, repair, secret_scan, warc

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_bpe_round_trip,
        near.op2_weighted_minhash,
        warc.op3_arc_to_warc,
        langid.op4_language_id,
        repair.op5_repair_token_files,
        packing.op6_vector_packing,
        secret_scan.op7_blob_ledger,
        exact.op8_heavy_hitter_dedup,
        chat.op9_chat_formatting,
        omh.op10_order_min_hash,
    )
}
ORACLES = {"op7_blob_ledger": secret_scan.OP7_SQL, "op8_heavy_hitter_dedup": exact.OP8_SQL}
