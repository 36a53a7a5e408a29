"""Views that shape the given tables into gage, weather and attribute tables. The same text runs on Spark and in the SQL oracle, but
for the word for exploding an array."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "nation", "events")

#: In the order in which they build on each other.
VIEWS = {
    "fx_site_metadata": """
select lpad(cast(c_custkey as string), 8, '0') as site_id, c_name as station_name,
  case when c_custkey % 53 = 52 then null else 37e0 + (c_custkey % 40) * 0.25e0 end as latitude,
  case when c_custkey % 53 = 52 then null else -110e0 + floor(c_custkey / 40) * 0.25e0 end as longitude,
  abs(c_acctbal) as drainage_area_sq_mi,
  concat(case when c_nationkey % 3 = 0 then '07' else '10' end, lpad(cast(c_nationkey as string), 6, '0')) as huc_code
from customer
""",
    "fx_streamflow_15min": """
select lpad(cast(user_id as string), 8, '0') as site_id, ts as datetime,
  case when event_type = 'error' then null else value end as streamflow_cfs,
  value / 64e0 as gage_height_ft,
  concat_ws('|', nullif(event_type, 'error'), 'P') as qualifiers,
  timestamp '2024-02-01 00:00:00' as extracted_at
from events
""",
    "fx_streamflow_daily": """
select lpad(cast(user_id as string), 8, '0') as site_id, cast(ts as date) as date,
  min(value) as streamflow_cfs_mean, max(value) / 64e0 as gage_height_ft_mean,
  'P' as qualifiers, timestamp '2024-02-01 00:00:00' as extracted_at
from events group by user_id, cast(ts as date)
""",
    "fx_site_hours": """
select user_id, day_ts, explode(sequence(0, 23)) as h from (select distinct user_id, date_trunc('day', ts) as day_ts from events) d
""",
    "fx_weather_forcing": """
select s.longitude, s.latitude, k.day_ts + interval '1' hour * k.h as datetime,
  ((k.user_id * 7 + k.h * 3 + day(k.day_ts)) % 20) / 4e0 as prcp,
  ((k.user_id * 5 + k.h) % 40) / 2e0 - 5e0 as temp,
  ((k.user_id + k.h * 2) % 101) * 1e0 as humidity,
  ((k.user_id + day(k.day_ts)) % 16) / 2e0 as wind_speed,
  ((k.user_id * 11) % 360) * 1e0 as wind_direction,
  (k.h * 25) * 1e0 as rsds, 300e0 as rlds, 900e0 as psurf,
  k.h / 64e0 as pet, timestamp '2024-02-01 00:00:00' as extracted_at
from fx_site_hours k
join fx_site_metadata s on s.site_id = lpad(cast(k.user_id as string), 8, '0')
where s.latitude is not null and (k.user_id + k.h + day(k.day_ts)) % 11 <> 0
  and not (k.user_id % 13 = 5 and day(k.day_ts) = 15)
""",
    "fx_seed_basin": """
select lpad(cast(c_custkey as string), 8, '0') as staid, c_name as staname, abs(c_acctbal) * 2e0 as drain_sqkm, c_nationkey as huc02,
  37e0 as lat_gage, -110e0 as lng_gage, c_mktsegment as state,
  case when c_custkey % 4 = 0 then 'yes' else null end as hcdn_2009, cast(null as string) as hbn36
from customer where c_custkey % 10 <> 3
""",
    "fx_seed_topo": """
select lpad(cast(c_custkey as string), 8, '0') as staid, (c_custkey % 300) * 10e0 as elev_mean_m_basin, (c_custkey % 300) * 12e0 as elev_max_m_basin,
  (c_custkey % 300) * 8e0 as elev_min_m_basin, (c_custkey % 300) * 9e0 as elev_median_m_basin,
  (c_custkey % 7) / 2e0 as elev_std_m_basin, (c_custkey % 300) * 8e0 as elev_site_m, (c_custkey % 33) / 4e0 as slope_pct,
  (c_custkey % 360) * 1e0 as aspect_degrees, 0.5e0 as aspect_northness, -0.5e0 as aspect_eastness
from customer where c_custkey % 11 <> 4
""",
    "fx_seed_soils": """
select lpad(cast(c_custkey as string), 8, '0') as staid, 0.125e0 as awcave, 2.5e0 as permave, 1.25e0 as bdave, 0.5e0 as omave, 6e0 as wtdepave,
  (c_custkey % 60) * 1e0 as rockdepave, (c_custkey % 40) * 1e0 as clayave, (c_custkey % 30) * 1e0 as siltave,
  (c_custkey % 30) * 1e0 as sandave, 0.25e0 as kfact_up
from customer where c_custkey % 12 <> 5
""",
    "fx_seed_geology": """
select lpad(cast(c_custkey as string), 8, '0') as staid, case when c_custkey % 2 = 0 then 'granitic' else 'sedimentary' end as geol_reedbush_dom,
  75e0 as geol_reedbush_dom_pct, c_nationkey as geol_hunt_dom_code, 50e0 as geol_hunt_dom_pct, c_mktsegment as geol_hunt_dom_desc
from customer where c_custkey % 13 <> 6
""",
    "fx_seed_climate": """
select lpad(cast(c_custkey as string), 8, '0') as staid, (c_custkey % 9) / 2e0 as p_mean, (c_custkey % 7) / 2e0 as pet_mean, (c_custkey % 5) / 4e0 as aridity_index,
  0.25e0 as p_seasonality, (c_custkey % 4) / 4e0 as frac_snow, 20e0 as high_prec_freq, 1.25e0 as high_prec_dur,
  250e0 as low_prec_freq, 5.5e0 as low_prec_dur
from customer where c_custkey % 14 <> 7
""",
    "fx_seed_hydroatlas": """
select lpad(cast(c_custkey as string), 8, '0') as staid, (c_custkey % 300) * 10 as ele_mt_sav, (c_custkey % 90) * 1 as slp_dg_uav, (c_custkey % 200) * 1 as tmp_dc_syr,
  (c_custkey % 900) * 1 as pre_mm_syr, (c_custkey % 800) * 1 as pet_mm_syr, (c_custkey % 100) * 1 as ari_ix_uav,
  (c_custkey % 50) * 1 as cly_pc_uav, (c_custkey % 60) * 1 as snd_pc_uav, (c_custkey % 70) * 1 as for_pc_use,
  (c_custkey % 80) * 1 as crp_pc_use, (c_custkey % 10) * 1 as urb_pc_use
from customer where c_custkey % 15 <> 8
""",
    "fx_monitoring_locations": """
select lpad(cast(c_custkey as string), 8, '0') as monitoring_location_id, n_name as state_name,
  case when c_custkey % 17 = 0 then null
       else concat(case when c_custkey % 3 = 0 then '07' else '10' end, lpad(cast(c_nationkey as string), 6, '0')) end as hydrologic_unit_code
from customer join nation on c_nationkey = n_nationkey
""",
    "fx_timeseries_metadata": """
select m.monitoring_location_id, m.state_name, m.hydrologic_unit_code,
  case when e.user_id % 4 = 1 then null when e.event_type in ('click', 'error') then 'Instantaneous' when e.event_type = 'view' then 'Mean' else null end as computation_identifier,
  case when e.user_id % 3 = 2 then null when e.event_type = 'click' then 'Points' when e.event_type = 'view' then 'Daily' else null end as computation_period_identifier
from (select distinct user_id, event_type from events) e
join fx_monitoring_locations m on m.monitoring_location_id = lpad(cast(e.user_id as string), 8, '0')
""",
    "fx_existing_rows": """
select user_id, ts, value from events where ts < timestamp '2024-01-20 00:00:00'
""",
    "fx_incoming_rows": """
select user_id, ts, value + 1e0 as value from events where ts >= timestamp '2024-01-18 00:00:00'
""",
    "fx_model_runs": """
select event_id as run_id, ts as created_at, case when event_type = 'error' then 'failed' else 'finished' end as state,
  case when event_type = 'signup' then null else value end as test_mae,
  event_id % 10 <> 3 as has_model, event_id = 500 as is_production
from events
""",
}


class Views:
    """The fixture views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        for name, text in VIEWS.items():
            spark.sql(text).createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.spark.table(f"fx_{name}")


def needed(text: str) -> list[str]:
    """The views that a query text needs, directly or not, in order."""
    found, stack = set(), [text]
    while stack:
        for name in re.findall(r"\bfx_\w+", stack.pop()):
            if name not in found:
                found.add(name)
                stack.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def oracle(text: str, **more: str) -> str:
    """The text with the views it needs in front, and further named texts after them."""
    whole = " ".join([text, *more.values()])
    parts = [f"{name} as ({VIEWS[name].replace('explode(sequence(0, 23))', 'unnest(generate_series(0, 23))')})" for name in needed(whole)] + [f"{name} as ({sql})" for name, sql in more.items()]
    return f"with {', '.join(parts)} {text}" if parts else text
