"""Spaces, accounts, members, editors, proposals and votes.

Block events become operations on the indexer space; the views read them back.
"""

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph import schema
from braidgraph.functions import ids
from braidgraph.functions.predicates import Where, all_of, snapshot
from braidgraph.graph import Graph
from braidgraph.operators import overlay
from braidgraph.operators.overlay import Field
from braidgraph.plans.lineage import materialize
from braidgraph.vocabulary import (
    CREATE_RELATION,
    DEFAULT,
    DELETE_RELATION,
    SET_TRIPLE,
    VOTE_OPTIONS,
    Vocabulary,
)

# The order in which the events of one block are applied.
EVENT_ORDER = (
    "spaces_created",
    "personal_plugins_created",
    "governance_plugins_created",
    "initial_editors_added",
    "members_added",
    "members_removed",
    "editors_added",
    "editors_removed",
    "subspaces_added",
    "subspaces_removed",
    "proposed_added_members",
    "proposed_removed_members",
    "proposed_added_editors",
    "proposed_removed_editors",
    "proposed_added_subspaces",
    "proposed_removed_subspaces",
    "proposed_edits",
    "votes_cast",
    "edits_published",
    "executed_proposals",
)
# Applied even when governance is off.
ALWAYS_APPLIED = ("spaces_created", "subspaces_added", "subspaces_removed", "edits_published")

PROPOSAL_KINDS = {
    "proposed_added_members": ("add_member_proposal", "member"),
    "proposed_removed_members": ("remove_member_proposal", "member"),
    "proposed_added_editors": ("add_editor_proposal", "editor"),
    "proposed_removed_editors": ("remove_editor_proposal", "editor"),
    "proposed_added_subspaces": ("add_subspace_proposal", "subspace"),
    "proposed_removed_subspaces": ("remove_subspace_proposal", "subspace"),
    "proposed_edits": ("edit_proposal", "content_uri"),
}


def event_phase(kind: str = "kind") -> Column:
    """Rank of an event kind within its block."""
    pairs = [F.lit(x) for i, k in enumerate(EVENT_ORDER) for x in (k, i)]
    return F.try_element_at(F.create_map(*pairs), F.col(kind))


def fan_out(blocks: DataFrame) -> DataFrame:
    """One row per event: (block_number, block_ts, kind, pos, payload).

    The lists of a block are merged into one array of (kind, pos, payload) and exploded
    once, so a block is read a single time whatever its kinds.
    """

    def events(kind: str, payload) -> Column:
        own = set(payload.fieldNames())
        values = ", ".join(
            f"'{f.name}', " + (f"item.{f.name}" if f.name in own else
                               f"CAST(NULL AS {f.dataType.simpleString()})")
            for f in schema.PAYLOAD.fields
        )
        return F.expr(
            f"transform(coalesce({kind}, array()), (item, pos) -> named_struct("
            f"'kind', '{kind}', 'pos', pos, 'payload', named_struct({values})))"
        )

    kinds = [k for k in schema.EVENT_LISTS if k in blocks.columns]
    merged = F.concat(*[events(k, schema.EVENT_LISTS[k]) for k in kinds])
    return blocks.select(
        "block_number", "block_ts", F.explode(merged).alias("event")
    ).select("block_number", "block_ts", "event.*")


def applied(events: DataFrame, governance: bool = True) -> DataFrame:
    """The events a run handles: all known kinds, or the basic ones without governance."""
    kinds = EVENT_ORDER if governance else ALWAYS_APPLIED
    return events.filter(F.col("kind").isin(*kinds))


@dataclass(frozen=True)
class _Op:
    """A triple or relation operation: what it writes, and its compact shape."""

    op_type: str
    predicate: str
    subject: Column
    target: Column
    id: Column | None = None
    index: str | None = None
    type_id: str | None = None

    def shape(self, place: int) -> Column:
        """One struct for all kinds of operations, see :func:`_unfold`."""
        parts = {
            "n": F.lit(place), "op_type": F.lit(self.op_type), "subject": self.subject,
            "predicate": F.lit(self.predicate), "target": self.target,
            "id": F.lit(None).cast("string") if self.id is None else self.id,
            "index": F.lit(self.index).cast("string"),
        }
        return F.struct(*[part.alias(name) for name, part in parts.items()])


@dataclass(frozen=True)
class Writes:
    """The operations that are wanted; None stands for all.

    ``types`` narrows the relations that give an entity its type.
    """

    attributes: Collection[str] | None = None
    relation_types: Collection[str] | None = None
    types: Collection[str] | None = None

    def has(self, op: _Op) -> bool:
        kinds = self.attributes if op.op_type == SET_TRIPLE else self.relation_types
        if kinds is not None and op.predicate not in kinds:
            return False
        return self.types is None or op.type_id is None or op.type_id in self.types


def _triple(entity: Column, attribute: str, value: Column) -> _Op:
    return _Op(SET_TRIPLE, attribute, entity, value)


def _edge(op_type: str, id_: Column, type_: str, from_: Column, to: Column, index="0") -> _Op:
    return _Op(op_type, type_, from_, to, id_, index)


def _unfold(op: str) -> list[Column]:
    """The columns of the log from a compact operation."""

    def filled(struct, **fields) -> Column:
        return F.struct(
            *[
                (fields[f.name] if f.name in fields else F.lit(None).cast(f.dataType))
                .alias(f.name)
                for f in struct.fields
            ]
        )

    def part(name: str) -> Column:
        return F.col(f"{op}.{name}")

    is_triple = part("op_type") == SET_TRIPLE
    triple = filled(
        schema.TRIPLE, entity=part("subject"), attribute=part("predicate"),
        value=part("target"), value_type=F.lit("TEXT"),
    )
    relation = filled(
        schema.RELATION, id=part("id"), type=part("predicate"), from_entity=part("subject"),
        to_entity=part("target"), index=part("index"),
    )
    return [
        part("op_type").alias("op_type"),
        F.when(is_triple, triple).alias("triple"),
        F.when(~is_triple, relation).alias("relation"),
    ]


def _types(entity: Column, voc: Vocabulary, *types: str) -> list[_Op]:
    return [
        _Op(
            CREATE_RELATION, voc.types, entity, F.lit(t),
            ids.derived_id(F.lit(voc.indexer_space), entity, F.lit(voc.types), F.lit(t)),
            "0", type_id=t,
        )
        for t in types
    ]


def _account(address: Column, voc: Vocabulary) -> list[_Op]:
    account = ids.account_id(address)
    return [
        _triple(account, voc.address, ids.address_key(address)),
        *_types(account, voc, voc.account_type),
    ]


def membership_id(role: str, space: Column, account: Column) -> Column:
    return ids.derived_id(F.lit(role), space, account)


def parent_space_id(child: Column, parent: Column) -> Column:
    return ids.derived_id(F.lit("PARENT_SPACE"), child, parent)


def _handlers(voc: Vocabulary, network: Column) -> dict[str, Callable[[], list[_Op]]]:
    """The operations of each kind of event, over ``payload``."""

    def p(name: str) -> Column:
        return F.col(f"payload.{name}")

    space = ids.space_id(network, p("dao_address"))

    def space_created():
        created = F.coalesce(F.col("imported_space_id"), space)
        return [
            _triple(created, voc.network, network),
            _triple(created, voc.space_governance_type, F.lit("Public")),
            _triple(created, voc.space_dao_address, ids.address_key(p("dao_address"))),
            _triple(created, voc.space_plugin_address, ids.address_key(p("space_address"))),
            *_types(created, voc, voc.space_type),
        ]

    def personal_space():
        return [
            _triple(space, voc.space_governance_type, F.lit("Personal")),
            _triple(space, voc.space_personal_plugin_address,
                    ids.address_key(p("personal_admin_address"))),
            *_account(p("initial_editor"), voc),
        ]

    def governance_plugin():
        return [
            _triple(space, voc.space_voting_plugin_address,
                    ids.address_key(p("main_voting_address"))),
            _triple(space, voc.space_member_plugin_address,
                    ids.address_key(p("member_access_address"))),
        ]

    def role(name: str, relation_type: str, address: Column, added: bool):
        account = ids.account_id(address)
        op = CREATE_RELATION if added else DELETE_RELATION
        edge = _edge(op, membership_id(name, space, account), relation_type, account, space)
        return [*_account(address, voc), edge] if added else [edge]

    def subspace(added: bool):
        child = ids.space_id(network, p("subspace"))
        op = CREATE_RELATION if added else DELETE_RELATION
        return [_edge(op, parent_space_id(child, space), voc.parent_space, child, space)]

    def proposal(kind: str):
        type_name, subject = PROPOSAL_KINDS[kind]
        proposal = ids.proposal_id(p("plugin_address"), p("proposal_id"))
        creator = ids.account_id(p("creator"))
        made = [
            _triple(proposal, voc.onchain_proposal_id, p("proposal_id")),
            _triple(proposal, voc.proposal_status, F.lit("Proposed")),
            _triple(proposal, voc.plugin_address, ids.address_key(p("plugin_address"))),
            _triple(proposal, voc.start_time, p("start_time")),
            _triple(proposal, voc.end_time, p("end_time")),
            *_types(proposal, voc, voc.proposal_type, getattr(voc, type_name)),
            _edge(CREATE_RELATION, ids.derived_id(F.lit("PROPOSALS"), space, proposal),
                  voc.proposals, space, proposal, "a0"),
            _edge(CREATE_RELATION, ids.derived_id(F.lit("CREATOR"), proposal, creator),
                  voc.proposal_creator, proposal, creator),
        ]
        if subject in ("member", "editor"):
            account = ids.account_id(p(subject))
            made.append(
                _edge(CREATE_RELATION,
                      ids.derived_id(F.lit("PROPOSED_ACCOUNT"), proposal, account),
                      voc.proposed_account, proposal, account)
            )
        elif subject == "subspace":
            child = ids.space_id(network, p("subspace"))
            made.append(
                _edge(CREATE_RELATION,
                      ids.derived_id(F.lit("PROPOSED_SUBSPACE"), proposal, child),
                      voc.proposed_subspace, proposal, child)
            )
        else:
            made.append(_triple(proposal, voc.content_uri, p("content_uri")))
        return made

    def vote():
        voter = ids.account_id(p("voter"))
        proposal = ids.proposal_id(p("plugin_address"), p("onchain_proposal_id"))
        vote = ids.derived_id(F.lit("VOTE"), voter, proposal)
        return [
            _triple(vote, voc.vote_type, vote_name(p("vote_option"))),
            _edge(CREATE_RELATION, vote, voc.vote_cast, voter, proposal),
        ]

    def executed():
        proposal = ids.proposal_id(p("plugin_address"), p("proposal_id"))
        return [_triple(proposal, voc.proposal_status, F.lit("Executed"))]

    return {
        "spaces_created": space_created,
        "personal_plugins_created": personal_space,
        "governance_plugins_created": governance_plugin,
        "initial_editors_added": lambda: role("EDITOR", voc.editor, F.col("address"), True),
        "members_added": lambda: role("MEMBER", voc.member, p("member_address"), True),
        "members_removed": lambda: role("MEMBER", voc.member, p("member_address"), False),
        "editors_added": lambda: role("EDITOR", voc.editor, p("editor_address"), True),
        "editors_removed": lambda: role("EDITOR", voc.editor, p("editor_address"), False),
        "subspaces_added": lambda: subspace(True),
        "subspaces_removed": lambda: subspace(False),
        **{kind: (lambda kind=kind: proposal(kind)) for kind in PROPOSAL_KINDS},
        "votes_cast": vote,
        "executed_proposals": executed,
    }


def vote_name(option: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in VOTE_OPTIONS.items() for x in pair])
    return F.try_element_at(names, option.cast("int"))


def invalid_votes(events: DataFrame) -> DataFrame:
    """Votes with an option that is neither accept nor reject."""
    return events.filter(
        (F.col("kind") == "votes_cast") & vote_name(F.col("payload.vote_option")).isNull()
    )


def import_targets(
    events: DataFrame, content: DataFrame, network: str
) -> DataFrame:
    """(block_number, plugin, imported_space_id) of spaces that import another one."""
    once = content.dropDuplicates(["uri"])
    imports = once.filter("type = 'IMPORT_SPACE'").select(
        F.col("uri").alias("content_uri"),
        ids.space_id("previous_network", "previous_contract_address").alias("imported_space_id"),
    )
    published = events.filter("kind = 'edits_published'").select(
        "block_number", "pos",
        F.col("payload.content_uri").alias("content_uri"),
        ids.address_key("payload.plugin_address").alias("plugin"),
    )
    return (
        published.join(imports, "content_uri")
        .groupBy("block_number", "plugin")
        .agg(F.min_by("imported_space_id", "pos").alias("imported_space_id"))
    )


def event_ops(
    events: DataFrame,
    imports: DataFrame | None = None,
    governance: bool = True,
    vocabulary: Vocabulary = DEFAULT,
    network: str | None = None,
    writes: Writes = Writes(),
) -> DataFrame:
    """Operations of all block events except edits, or those that ``writes`` asks for.

    Every kind turns into an array of operations that is exploded in place: the events
    are read once and never shuffled, apart from the join of new spaces to the imports
    of their block. Kinds of events that write nothing that is asked for are not read.
    Votes with unknown codes are left out, see :func:`invalid_votes`.
    """
    made = F.lit(None).cast(_OP_ARRAY)
    kinds = []
    for kind, operations in _handlers(vocabulary, F.lit(network or vocabulary.home_network)).items():
        asked = [op.shape(n) for n, op in enumerate(operations()) if writes.has(op)]
        if asked:
            made = F.when(F.col("kind") == kind, F.array(*asked)).otherwise(made)
            kinds.append(kind)
    events = applied(events, governance).filter(F.col("kind").isin(kinds))
    events = events.filter(
        (F.col("kind") != "votes_cast") | vote_name(F.col("payload.vote_option")).isNotNull()
    )
    if imports is None:
        events = events.withColumn("imported_space_id", F.lit(None).cast("string"))
    else:
        events = events.withColumn(
            "plugin",
            F.when(F.col("kind") == "spaces_created", ids.address_key("payload.space_address")),
        ).join(imports, ["block_number", "plugin"], "left")
    addresses = F.when(
        F.col("kind") == "initial_editors_added", F.col("payload.addresses")
    ).otherwise(F.array(F.lit(None).cast("string")))
    events = events.select("*", F.posexplode_outer(addresses).alias("address_pos", "address"))

    # A function over the array is evaluated apart: generated with the rest of the stage, the
    # branches of all kinds are one method, too long for the JVM to compile.
    made = F.filter(made, lambda op: op["op_type"].isNotNull())
    rows = events.select(
        "block_number", "block_ts", event_phase().alias("event_phase"), "pos", "address_pos",
        F.explode(made).alias("op"),
    )
    # Events of a block are ordered by kind, then position, then place in the event.
    position = (
        F.col("event_phase").cast("bigint") * 10**14
        + F.col("pos").cast("bigint") * 10**8
        + F.col("address_pos").cast("bigint") * 100
        + F.col("op.n")
    )
    return rows.select(
        "block_number", "block_ts", F.lit(0).alias("edit_idx"), position.alias("op_pos"),
        F.lit(vocabulary.indexer_space).alias("space_id"),
        *_unfold("op"),
    )


_OP_ARRAY = (
    "array<struct<n:int,op_type:string,subject:string,predicate:string,target:string,"
    "id:string,index:string>>"
)


# Views.


def space_fields(voc: Vocabulary) -> dict[str, Field]:
    return {
        "network": Field(voc.network),
        "governance_type": Field(voc.space_governance_type),
        "dao_address": Field(voc.space_dao_address),
        "space_plugin": Field(voc.space_plugin_address, required=False),
        "voting_plugin": Field(voc.space_voting_plugin_address, required=False),
        "member_plugin": Field(voc.space_member_plugin_address, required=False),
        "personal_plugin": Field(voc.space_personal_plugin_address, required=False),
    }


def account_fields(voc: Vocabulary) -> dict[str, Field]:
    return {"address": Field(voc.address)}


def proposal_fields(voc: Vocabulary) -> dict[str, Field]:
    return {
        "onchain_proposal_id": Field(voc.onchain_proposal_id),
        "status": Field(voc.proposal_status),
        "plugin_address": Field(voc.plugin_address),
        "start_time": Field(voc.start_time),
        "end_time": Field(voc.end_time),
        "content_uri": Field(voc.content_uri, required=False),
    }


def _view(graph: Graph, type_id: str, fields: dict[str, Field], where=None) -> DataFrame:
    return overlay.find(
        graph, type_id, fields, where, space_id=graph.vocabulary.indexer_space, limit=None
    )


def spaces(graph: Graph, where: dict[str, Where] | None = None) -> DataFrame:
    """Spaces with their network, governance type and addresses, filtered by field."""
    fields = space_fields(graph.vocabulary)
    return _page_filter(_view(graph, graph.vocabulary.space_type, fields), where)


def accounts(graph: Graph, where: dict[str, Where] | None = None) -> DataFrame:
    """Accounts with their address, filtered by field (including ``entity``)."""
    fields = account_fields(graph.vocabulary)
    return _page_filter(_view(graph, graph.vocabulary.account_type, fields), where)


def _page_filter(rows: DataFrame, where: dict[str, Where] | None) -> DataFrame:
    return rows.filter(all_of([w.on(name) for name, w in (where or {}).items()]))


def by_address(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of a view whose address in ``column`` is among ``keys.address``."""
    wanted = keys.select(ids.address_key("address").alias(column)).distinct()
    return rows.join(wanted, column, "left_semi")


def spaces_by_dao(graph: Graph, keys: DataFrame, network: str | None = None) -> DataFrame:
    """Space nodes by the id derived from their DAO address."""
    network_id = F.lit(network or graph.vocabulary.home_network)
    wanted = keys.select(ids.space_id(network_id, "address").alias("id")).distinct()
    # Written first, so that its true size decides how the join is done.
    wanted = materialize(wanted, "wanted-spaces")
    return graph.entities.join(wanted, "id", "left_semi")


def role_holders(graph: Graph, relation_type: str, roots: DataFrame | None = None) -> DataFrame:
    """(space_id, account, address) of the members or editors of spaces, in one join."""
    voc = graph.vocabulary
    edges = graph.relations.filter(
        snapshot()
        & (F.col("relation_type") == relation_type)
        & (F.col("space_id") == voc.indexer_space)
    ).select(F.col("to_id").alias("held_in"), F.col("from_id").alias("entity"))
    if roots is not None:
        edges = edges.join(
            roots.select(F.col("space_id").alias("held_in")).distinct(), "held_in", "left_semi"
        )
    held = edges.distinct().join(accounts(graph), "entity")
    return held.select(F.col("held_in").alias("space_id"), F.col("entity").alias("account"), "address")


def members(graph: Graph, roots: DataFrame | None = None) -> DataFrame:
    return role_holders(graph, graph.vocabulary.member, roots)


def editors(graph: Graph, roots: DataFrame | None = None) -> DataFrame:
    return role_holders(graph, graph.vocabulary.editor, roots)


def proposals(graph: Graph) -> DataFrame:
    """Proposals with their kind, space, creator and subject."""
    voc = graph.vocabulary
    current = graph.relations.filter(
        snapshot() & (F.col("space_id") == voc.indexer_space)
    )
    base = _view(graph, voc.proposal_type, proposal_fields(voc))
    kinds = {getattr(voc, name): name for name, _ in PROPOSAL_KINDS.values()}
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])

    def subject(of: Column, relation_type: str) -> Column:
        return F.max(F.when(F.col("relation_type") == relation_type, of))

    # One pass over the relations around proposals, one row per proposal.
    is_kind = (F.col("relation_type") == voc.types) & F.col("to_id").isin(*kinds)
    outgoing = [voc.proposal_creator, voc.proposed_account, voc.proposed_subspace]
    around = (
        current.filter(
            is_kind
            | (F.col("relation_type") == voc.proposals)
            | F.col("relation_type").isin(*outgoing)
        )
        .withColumn(
            "entity",
            F.when(F.col("relation_type") == voc.proposals, F.col("to_id")).otherwise(
                F.col("from_id")
            ),
        )
        .groupBy("entity")
        .agg(
            subject(F.try_element_at(names, F.col("to_id")), voc.types).alias("kind"),
            subject(F.col("from_id"), voc.proposals).alias("space_id"),
            subject(F.col("to_id"), voc.proposal_creator).alias("creator"),
            subject(F.col("to_id"), voc.proposed_account).alias("proposed_account"),
            subject(F.col("to_id"), voc.proposed_subspace).alias("proposed_subspace"),
        )
    )
    return base.join(around, "entity", "left")


def proposals_by_onchain_id(graph: Graph, keys: DataFrame) -> DataFrame:
    """Proposals by (onchain_proposal_id, plugin_address)."""
    wanted = keys.select(
        "onchain_proposal_id", ids.address_key("plugin_address").alias("plugin_address")
    ).distinct()
    return proposals(graph).join(
        wanted, ["onchain_proposal_id", "plugin_address"], "left_semi"
    )


def votes(graph: Graph) -> DataFrame:
    """(voter, proposal, vote) of every vote."""
    voc = graph.vocabulary
    view = overlay.relation_view(graph, voc.vote_cast, {"vote": Field(voc.vote_type)})
    return view.select("id", F.col("from_id").alias("voter"), F.col("to_id").alias("proposal"), "vote")

