"""Schemas of the canonical tables."""

from pyspark.sql import types as T

_s, _l, _i, _ts = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(**fields):
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


TRIPLE = _struct(
    entity=_s, attribute=_s, value=_s, value_type=_s, format=_s, unit=_s, language=_s
)
RELATION = _struct(id=_s, type=_s, from_entity=_s, to_entity=_s, index=_s)

OPS = _struct(
    block_number=_l, block_ts=_ts, edit_idx=_i, op_pos=_l, space_id=_s, op_type=_s,
    triple=TRIPLE, relation=RELATION,
)
TRIPLES = _struct(
    entity=_s, attribute=_s, space_id=_s, value=_s, value_type=_s, format=_s, unit=_s,
    language=_s, embedding=T.ArrayType(T.DoubleType()), min_version=_s, max_version=_s,
)
RELATIONS = _struct(
    id=_s, from_id=_s, to_id=_s, relation_type=_s, index=_s, space_id=_s,
    min_version=_s, max_version=_s,
    created_at=_ts, created_at_block=_s, updated_at=_ts, updated_at_block=_s,
)
ENTITIES = _struct(
    id=_s, created_at=_ts, created_at_block=_s, updated_at=_ts, updated_at_block=_s
)

# Content of one published edit, as landed by the content fetcher.
CONTENT_OP = _struct(type=_s, triple=TRIPLE, relation=RELATION)
CONTENT = _struct(
    uri=_s, type=_s, id=_s, name=_s, authors=T.ArrayType(_s), ops=T.ArrayType(CONTENT_OP),
    edits=T.ArrayType(_s), previous_network=_s, previous_contract_address=_s,
)

# One block: every list holds the events of one kind, in order.
_common = dict(dao_address=_s, plugin_address=_s)
_member = _struct(member_address=_s, change_type=_s, **_common)
_editor = _struct(editor_address=_s, change_type=_s, **_common)
_subspace = _struct(subspace=_s, change_type=_s, **_common)


def _proposal(**subject):
    return _struct(
        proposal_id=_s, creator=_s, start_time=_s, end_time=_s, **subject, **_common
    )


EVENT_LISTS = {
    "spaces_created": _struct(dao_address=_s, space_address=_s),
    "personal_plugins_created": _struct(
        dao_address=_s, personal_admin_address=_s, initial_editor=_s
    ),
    "governance_plugins_created": _struct(
        dao_address=_s, main_voting_address=_s, member_access_address=_s
    ),
    "initial_editors_added": _struct(addresses=T.ArrayType(_s), **_common),
    "members_added": _member,
    "members_removed": _member,
    "editors_added": _editor,
    "editors_removed": _editor,
    "subspaces_added": _subspace,
    "subspaces_removed": _subspace,
    "proposed_added_members": _proposal(member=_s),
    "proposed_removed_members": _proposal(member=_s),
    "proposed_added_editors": _proposal(editor=_s),
    "proposed_removed_editors": _proposal(editor=_s),
    "proposed_added_subspaces": _proposal(subspace=_s),
    "proposed_removed_subspaces": _proposal(subspace=_s),
    "proposed_edits": _proposal(content_uri=_s),
    "votes_cast": _struct(
        onchain_proposal_id=_s, voter=_s, vote_option=_l, plugin_address=_s
    ),
    "edits_published": _struct(content_uri=_s, **_common),
    "executed_proposals": _struct(proposal_id=_s, plugin_address=_s),
    "successor_spaces_created": _struct(
        predecessor_space=_s, plugin_address=_s, dao_address=_s
    ),
}

# All payload fields side by side: the shape of one fanned-out event row.
PAYLOAD = T.StructType(
    [
        T.StructField(name, dtype)
        for name, dtype in {
            field.name: field.dataType
            for struct in EVENT_LISTS.values()
            for field in struct.fields
        }.items()
    ]
)

BLOCKS = T.StructType(
    [T.StructField("block_number", _l), T.StructField("block_ts", _ts)]
    + [
        T.StructField(kind, T.ArrayType(payload))
        for kind, payload in EVENT_LISTS.items()
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("block_number", _l),
        T.StructField("block_ts", _ts),
        T.StructField("kind", _s),
        T.StructField("pos", _i),
        T.StructField("payload", PAYLOAD),
    ]
)
