"""Schemas of the input documents and of the shared outputs."""

from __future__ import annotations

from outlay.functions.money import MONEY

LABELS = "array<struct<key:string,value:string>>"

BILLING_LINE = f"""
  ingest_date date,
  usage_start_time timestamp, usage_end_time timestamp, export_time timestamp,
  invoice struct<month:string>,
  project struct<id:string,name:string,number:string,labels:{LABELS}>,
  labels {LABELS}, system_labels {LABELS},
  resource struct<name:string,global_name:string>,
  service struct<description:string>,
  sku struct<id:string,description:string>,
  location struct<region:string,zone:string>,
  cost {MONEY},
  credits array<struct<name:string,full_name:string,id:string,type:string,amount:{MONEY}>>,
  cost_type string,
  usage struct<amount:double,unit:string,amount_in_pricing_units:double,pricing_unit:string>,
  currency string, currency_conversion_rate double, cost_at_list {MONEY},
  price struct<effective_price:double>
"""

ASSET = "name string, update_time timestamp, resource struct<data:string>"

# The seven named lists of an inventory document.
INVENTORY = {
    "disks": """array<struct<name:string,zone:string,type:string,size_gb:int,users:array<string>,
        labels:map<string,string>,last_attach_timestamp:timestamp,last_detach_timestamp:timestamp,
        creation_timestamp:timestamp>>""",
    "addresses": """array<struct<name:string,region:string,address:string,status:string,
        address_type:string,users:array<string>,creation_timestamp:timestamp,
        labels:map<string,string>>>""",
    "instances": """array<struct<name:string,zone:string,machine_type:string,status:string,
        labels:map<string,string>,last_stop_timestamp:timestamp,
        disks:array<struct<name:string,size_gb:int,type:string>>>>""",
    "snapshots": """array<struct<name:string,source_disk:string,storage_bytes:bigint,
        creation_timestamp:timestamp,labels:map<string,string>>>""",
    "node_pools": """array<struct<cluster:string,location:string,name:string,machine_type:string,
        node_count:int,autoscaling:struct<enabled:boolean,min:int,max:int>,spot:boolean,
        running_pods_excluding_daemonsets:int>>""",
    "forwarding_rules": """array<struct<name:string,region:string,load_balancing_scheme:string,
        target:string,backend_service_healthy_backends:int,backends_total:int>>""",
    "cloudsql_instances": """array<struct<name:string,region:string,tier:string,state:string,
        storage_gb:int,connections_p95_14d:int,cpu_utilization_avg_14d:double,
        labels:map<string,string>>>""",
}

FINDING_COLUMNS = (
    "category",
    "resource",
    "severity",
    "monthly_cost_estimate",
    "recommendation",
    "excluded",
    "details",
)

VPA_ITEMS = """struct<items:array<struct<
    metadata:struct<namespace:string,name:string>,
    spec:struct<targetRef:struct<name:string>>,
    status:struct<recommendation:struct<containerRecommendations:array<struct<
        containerName:string,target:struct<cpu:string,memory:string>>>>>>>>"""
