"""Typed relational analytics on Spark."""

from .database import Database, QueryEvent, Transaction
from .errors import *  # noqa: F403
from .functions.raw import sql, sql_id, sql_join, sql_lit
from .kinds import UNSET, Kind
from .operators.select import fragment, select_from
from .operators.write import delete_from, insert_into, update
from .plans.expr import expression_builder
from .schema import (
    Codec,
    Column,
    Table,
    array,
    bigint,
    boolean,
    bytea,
    date,
    daterange,
    decimal,
    define_enum,
    define_table,
    define_type,
    double_precision,
    inet,
    integer,
    interval,
    jsonb,
    real,
    smallint,
    text,
    time,
    timestamp,
    timestamptz,
    tstzrange,
    tsvector,
    uuid,
    varchar,
    vector,
)
