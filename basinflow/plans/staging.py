"""Staging projections: raw names to model names, nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed column names: model column, or "raw column: model column" where they differ.
COLUMNS = {
    "site_metadata": "site_id station_name latitude longitude drainage_area_sq_mi huc_code",
    "streamflow": "site_id datetime:observed_at streamflow_cfs gage_height_ft qualifiers extracted_at",
    "streamflow_daily": "site_id date:observed_date streamflow_cfs_mean gage_height_ft_mean qualifiers extracted_at",
    "weather": "longitude latitude datetime:observed_at prcp:precipitation_mm temp:temperature_c humidity:humidity_pct wind_speed:wind_speed_ms wind_direction:wind_direction_deg rsds:shortwave_radiation_wm2 pet:pet_mm extracted_at",
    "basin": "staid:site_id staname:station_name drain_sqkm:drainage_area_sq_km huc02 lat_gage:latitude lng_gage:longitude state hcdn_2009:is_reference_hcdn2009 hbn36:is_reference_hbn36",
    "topo": "staid:site_id elev_mean_m_basin:elev_mean_m elev_max_m_basin:elev_max_m elev_min_m_basin:elev_min_m elev_median_m_basin:elev_median_m elev_std_m_basin:elev_std_m elev_site_m slope_pct aspect_degrees:aspect_deg aspect_northness aspect_eastness",
    "soils": "staid:site_id awcave:soil_water_capacity_avg permave:soil_permeability_avg bdave:bulk_density_avg omave:organic_matter_avg wtdepave:water_table_depth_avg rockdepave:rock_depth_avg clayave:clay_pct_avg siltave:silt_pct_avg sandave:sand_pct_avg kfact_up:erodibility_factor",
    "geology": "staid:site_id geol_reedbush_dom:geology_class_reedbush geol_reedbush_dom_pct:geology_pct_reedbush geol_hunt_dom_code:geology_code_hunt geol_hunt_dom_pct:geology_pct_hunt geol_hunt_dom_desc:geology_desc_hunt",
    "climate": "staid:site_id p_mean pet_mean aridity_index p_seasonality frac_snow high_prec_freq high_prec_dur low_prec_freq low_prec_dur",
}


def pairs(name: str) -> list[tuple[str, str]]:
    return [(x.split(":")[0], x.split(":")[-1]) for x in COLUMNS[name].split()]


def staged(name: str, raw: DataFrame) -> DataFrame:
    if name == "hydroatlas":  # as wide as its file: all columns, the key last
        return raw.select(*[c for c in raw.columns if c != "staid"], F.col("staid").alias("site_id"))
    return raw.select(*[F.col(old).alias(new) for old, new in pairs(name)])


def select_list(name: str) -> str:
    """The same projection as SQL."""
    return ", ".join(old if old == new else f"{old} as {new}" for old, new in pairs(name))
