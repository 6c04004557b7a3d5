"""The queries of this folder, and the SQL of those that SQL can express."""

from . import imatch, langid, linededup, mixing, packing, phrases, quality, resample, sharding, simhash, urlfilter, vectordedup, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_pack": packing.op2_pack,
    "op3_urlfilter": urlfilter.op3_urlfilter,
    "op4_langid": langid.op4_langid,
    "op5_simhash": simhash.op5_simhash,
    "op6_linededup": linededup.op6_linededup,
    "op7_warc": warc.op7_warc,
    "op8_shard": sharding.op8_shard,
    "op9_imatch": imatch.op9_imatch,
    "op10_vectordedup": vectordedup.op10_vectordedup,
    "op11_resample": resample.op11_resample,
    "op12_quality": quality.op12_quality,
    "op13_phrases": phrases.op13_phrases,
}
ORACLE = {"op1_mix": mixing.SQL, "op7_warc": warc.SQL, "op11_resample": resample.SQL, "op13_phrases": phrases.SQL}
