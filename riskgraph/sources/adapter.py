"""The card-fraud tables as views of the driver's ``events``.

``Tables`` gives transactions, identities, closed cases and alerts by name; each
is a projection of one scan, so filters and columns reach the Parquet reader.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.sources.files import scratch

ONLINE = ("click", "view", "purchase")

#: The same views as SQL text for the oracle.
SQL_VIEWS = """ev0 AS (
  select event_id, user_id, ts, event_type, value, cast(regexp_extract(props,'([0-9]+)',1) as int) k from events
), txn AS (
  select cast(event_id as STRING) txn_id, concat('K', cast(user_id as STRING)) card_id,
    concat('C', cast(user_id%50 as STRING)) customer_id, ts, value amt,
    case event_type when 'click' then 'C' when 'view' then 'H' when 'purchase' then 'R' else 'W' end product_cd,
    case when event_type in ('click','view','purchase') then 'online' else 'in_person' end channel,
    least(0.99, floor(value/5)/100) risk_score,
    case when k%6=5 then null when k%4=0 then cast(k%10 as STRING) else cast(user_id%10 as STRING) end addr1,
    case when k%8=7 then null else concat('mail', cast(k%7 as STRING), '.com') end p_email,
    case when k%5=0 then 'F' else 'T' end m1,
    case k%4 when 0 then 'M0' when 1 then 'M1' when 2 then 'M2' end m4,
    case when k%7=0 then 'F' else 'T' end m6 from ev0
), identity AS (
  select cast(event_id as STRING) txn_id, concat('Dev', cast(k as STRING)) device_info,
    case when k%2=0 then 'Android' end id_30, 'chrome' id_31, case when k%3=0 then '1920x1080' end id_33,
    case k%3 when 0 then 'New' when 1 then 'Found' end id_15,
    case when k%10=0 then 'IP_PROXY:ANONYMOUS' end id_23,
    case when k%2=0 then 'mobile' else 'desktop' end device_type
  from ev0 where event_type in ('click','view','purchase') and k<96
), closed_case AS (
  select concat('CC-', cast(event_id as STRING)) case_id, concat('C', cast(user_id%50 as STRING)) customer_id,
    concat('K', cast(user_id as STRING)) card_id, ts + interval '6' hour opened_at, ts + interval '54' hour closed_at,
    case when k%5=0 then 'cleared' else 'confirmed_fraud' end outcome,
    case k%5 when 0 then 'none' when 1 then 'card_testing' when 2 then 'card_not_present_fraud'
             when 3 then 'out_of_region_use' else 'account_takeover' end pattern,
    cast(event_id as STRING) first_fraud_txn_id,
    concat(cast(event_id as STRING), '|', cast(event_id+1 as STRING)) txn_ids, 2 n_txns,
    case when k%5=0 then 0e0 else value end exposure_usd,
    case when k%9=0 then concat('K', cast(user_id+1 as STRING), '|K', cast(user_id+2 as STRING)) end connected_card_ids,
    case when k%5=0 then 'VERIFY_WITH_CUSTOMER|CLOSE_NO_FRAUD' when value>=100 then 'CREATE_CASE|BLOCK_CARD|FILE_REPORT'
         else 'CREATE_CASE|BLOCK_CARD' end actions_taken,
    case when k%5<>0 and value>=100 then 'Yes' else 'No' end report_filed
  from ev0 where event_type='error' and k%4<>3
), alert AS (
  select concat('A-', cast(event_id as STRING)) case_id, ts + interval '1' hour opened_at,
    case k%3 when 0 then 'risk_score' when 1 then 'customer_report' else 'analyst_request' end trigger_type,
    cast(event_id as STRING) flagged_txn_id, concat('K', cast(user_id as STRING)) card_id,
    concat('C', cast(user_id%50 as STRING)) customer_id,
    case when k%3=0 then least(0.99, floor(value/5)/100) end risk_score,
    case k%4 when 0 then 'confirms' when 1 then 'denies' when 2 then 'no_reply' else 'none' end customer_response
  from ev0 where value>=150
), scored AS (
  select doc_id, quality y, ((doc_id*7919)%100 + 50*quality)/150e0 p from labels
)"""


def _string(e: str) -> str:
    return f"cast({e} as string)"


class Tables:
    """The views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def kept(self) -> Tables:
        """The same views over the events with their number taken out and written to the shared folder, for queries that read them many times: a view's columns and filters would evaluate the pattern again wherever they name the number."""
        other = Tables(self.spark, self.sf_dir)
        path = scratch(self.spark, "events")
        self._events.write.parquet(path)
        other._events = self.spark.read.schema(self._events.schema).parquet(path)
        return other

    @cached_property
    def _events(self) -> DataFrame:
        number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        return self.read("events").select("event_id", "user_id", "ts", "event_type", "value", number.alias("k"))

    @cached_property
    def txn(self) -> DataFrame:
        online = F.col("event_type").isin(*ONLINE)
        product = F.when(F.col("event_type") == "click", "C").when(F.col("event_type") == "view", "H").when(F.col("event_type") == "purchase", "R").otherwise("W")
        return self._events.select(
            F.expr(f"{_string('event_id')} txn_id"),
            F.expr(f"concat('K', {_string('user_id')}) card_id"),
            F.expr(f"concat('C', {_string('user_id % 50')}) customer_id"),
            "ts",
            F.col("value").alias("amt"),
            product.alias("product_cd"),
            F.when(online, "online").otherwise("in_person").alias("channel"),
            F.expr("least(0.99D, floor(value / 5) / 100) risk_score"),
            F.expr(f"case when k % 6 = 5 then null when k % 4 = 0 then {_string('k % 10')} else {_string('user_id % 10')} end addr1"),
            F.expr(f"case when k % 8 <> 7 then concat('mail', {_string('k % 7')}, '.com') end p_email"),
            F.expr("if(k % 5 = 0, 'F', 'T') m1"),
            F.expr("case k % 4 when 0 then 'M0' when 1 then 'M1' when 2 then 'M2' end m4"),
            F.expr("if(k % 7 = 0, 'F', 'T') m6"),
        )

    @cached_property
    def identity(self) -> DataFrame:
        return self._events.where(F.col("event_type").isin(*ONLINE) & (F.col("k") < 96)).select(
            F.expr(f"{_string('event_id')} txn_id"),
            F.expr(f"concat('Dev', {_string('k')}) device_info"),
            F.expr("if(k % 2 = 0, 'Android', null) id_30"),
            F.lit("chrome").alias("id_31"),
            F.expr("if(k % 3 = 0, '1920x1080', null) id_33"),
            F.expr("case k % 3 when 0 then 'New' when 1 then 'Found' end id_15"),
            F.expr("if(k % 10 = 0, 'IP_PROXY:ANONYMOUS', null) id_23"),
            F.expr("if(k % 2 = 0, 'mobile', 'desktop') device_type"),
        )

    @cached_property
    def closed_case(self) -> DataFrame:
        return self._events.where("event_type = 'error' AND k % 4 <> 3").select(
            F.expr(f"concat('CC-', {_string('event_id')}) case_id"),
            F.expr(f"concat('C', {_string('user_id % 50')}) customer_id"),
            F.expr(f"concat('K', {_string('user_id')}) card_id"),
            F.expr("ts + interval '6' hour opened_at"),
            F.expr("ts + interval '54' hour closed_at"),
            F.expr("if(k % 5 = 0, 'cleared', 'confirmed_fraud') outcome"),
            F.expr("case k % 5 when 0 then 'none' when 1 then 'card_testing' when 2 then 'card_not_present_fraud' when 3 then 'out_of_region_use' else 'account_takeover' end pattern"),
            F.expr(f"{_string('event_id')} first_fraud_txn_id"),
            F.expr(f"concat({_string('event_id')}, '|', {_string('event_id + 1')}) txn_ids"),
            F.lit(2).alias("n_txns"),
            F.expr("if(k % 5 = 0, 0D, value) exposure_usd"),
            F.expr(f"if(k % 9 = 0, concat('K', {_string('user_id + 1')}, '|K', {_string('user_id + 2')}), null) connected_card_ids"),
            F.expr("case when k % 5 = 0 then 'VERIFY_WITH_CUSTOMER|CLOSE_NO_FRAUD' when value >= 100 then 'CREATE_CASE|BLOCK_CARD|FILE_REPORT' else 'CREATE_CASE|BLOCK_CARD' end actions_taken"),
            F.expr("if(k % 5 <> 0 and value >= 100, 'Yes', 'No') report_filed"),
        )

    @cached_property
    def alert(self) -> DataFrame:
        return self._events.where("value >= 150").select(
            F.expr(f"concat('A-', {_string('event_id')}) case_id"),
            F.expr("ts + interval '1' hour opened_at"),
            F.expr("case k % 3 when 0 then 'risk_score' when 1 then 'customer_report' else 'analyst_request' end trigger_type"),
            F.expr(f"{_string('event_id')} flagged_txn_id"),
            F.expr(f"concat('K', {_string('user_id')}) card_id"),
            F.expr(f"concat('C', {_string('user_id % 50')}) customer_id"),
            F.expr("if(k % 3 = 0, least(0.99D, floor(value / 5) / 100), null) risk_score"),
            F.expr("case k % 4 when 0 then 'confirms' when 1 then 'denies' when 2 then 'no_reply' else 'none' end customer_response"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.read("labels").select("doc_id", F.col("quality").alias("y"), F.expr("((doc_id * 7919) % 100 + 50 * quality) / 150D p"))
