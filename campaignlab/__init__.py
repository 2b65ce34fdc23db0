"""Campaign audiences and campaign results on Spark.

Operators are plain functions from DataFrames to a DataFrame:

* ``campaignlab.operators.audience`` -- audience extraction (who to contact);
* ``campaignlab.operators.activity`` -- what an audience did after a campaign;
* ``campaignlab.operators.status`` -- status uploads applied to the user table;
* ``campaignlab.sources`` -- table loading, CSV uploads/exports, JDBC;
* ``campaignlab.plans`` -- named queries with their SQL equivalents.
"""

__version__ = "0.1.0"

from campaignlab.operators.activity import campaign_report, load_audience, write_report  # noqa: E402
from campaignlab.plans.extract import (  # noqa: E402
    export_audience, extract_data, run_activity_check, run_update_user_status,
)
from campaignlab.sources.tables import CampaignTables, load_tables, save_tables  # noqa: E402

__all__ = ["CampaignTables", "campaign_report", "export_audience", "extract_data", "load_audience", "load_tables",
           "run_activity_check", "run_update_user_status", "save_tables", "write_report"]
