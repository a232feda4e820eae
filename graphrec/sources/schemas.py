"""Names of columns in the inputs."""

from __future__ import annotations

#: Names under which logs carry the three columns that every job needs, in order of preference. Fixed values.
EVENT_ALIASES = {
    "client_id": ["client_id", "clientid", "user_id", "userid", "user"],
    "item_id": ["item_id", "itemid", "ad_id", "ilan_id", "item"],
    "timestamp": ["timestamp", "event_time", "datetime", "date", "time"],
}
#: Names of catalogue columns in the source system, and ours.
ITEM_NAMES = {"pozisyon_adi": "title", "item_id_aciklama": "description"}
