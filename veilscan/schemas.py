"""The tables of the screening engine."""

SIGNAL = "struct<name:string,score:int,detail:string,metric:double>"
SIGNALS = f"array<{SIGNAL}>"
FINDINGS = f"item_id string, analyzer string, suspicion int, signals {SIGNALS}, explanation string, error string"
FILE_ITEM = "item_id string, ext string, length bigint, content binary"
TEXT_ITEM = "item_id string, ext string, text string"
SAMPLE_ITEM = "item_id string, kind string, samples array<int>"
