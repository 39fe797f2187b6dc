"""The ids a graph uses for its system attributes, types and relation types.

Every operator takes these ids from a :class:`Vocabulary`, so a graph with other
ids only has to pass its own instance.
"""

from dataclasses import dataclass


@dataclass(frozen=True)
class Vocabulary:
    # Public well-known ids of the data model.

    # attributes
    name: str = "LuBWqZAu6pz54eiJS5mLv8"
    description: str = "LA1DqP5v6QAdsgLPXGF3YA"
    cover: str = "7YHk6qYkNDaAtNb8GwmysF"
    aggregation_direction: str = "6zd9BPJNdUpcKenuK7LjCh"
    address: str = "HXLpAZyQkcy6Di4YJu4xzU"
    network: str = "MuMLDVbHAmRjZQjhyk3HGx"
    space_governance_type: str = "DEnbDZp79wgfvUXMGJPXDW"
    space_dao_address: str = "Eye1MG1mjzRba4poijsttb"
    space_plugin_address: str = "8WQFgjEoqNYHPS9niQGcfC"
    space_voting_plugin_address: str = "GMuFbsoSsVmiMcCxc34zZA"
    space_member_plugin_address: str = "AGaTTZWAbEaSrmZYTinQuc"
    space_personal_plugin_address: str = "F75rm9StiixRKWTRiHGgvS"
    vote_type: str = "UrTNUMukLGV2y4yWEnBKQv"
    onchain_proposal_id: str = "onchain_proposal_id"
    proposal_status: str = "status"
    plugin_address: str = "plugin_address"
    start_time: str = "start_time"
    end_time: str = "end_time"
    content_uri: str = "content_uri"
    edit_index: str = "edit_index"

    # relation types
    types: str = "Jfmby78N4BCseZinBmdVov"
    properties: str = "9zBADaYzyfzyFJn4GU1cC"
    value_type: str = "WQfdWjboZWFuTseDhG5Cw1"
    relation_value_type: str = "LdAS7yWqF32E2J4doUDe5u"
    blocks: str = "QYbjCM6NT9xmh2hFGsqpQX"
    parent_space: str = "4jLdUCbpRzdjnpjhViDm2d"
    member: str = "2oGooh2PEUo8pbdMPqcBrQ"
    editor: str = "24TNsjdHUhuC5qtsN13stv"
    vote_cast: str = "PfgzdxPYwDUTBCzkXCT9ga"
    proposals: str = "3gmeTonVCB6B11p3YF8mj5"
    proposal_creator: str = "FUS7nfaWo8Ugzv9AxsMPNX"
    proposed_account: str = "N95e2Jvfe3VX5d6jc9owY6"
    proposed_subspace: str = "5ZVrZv7S3Mk2ATV9LAZAha"
    proposed_edit: str = "8NPzSYo8fXBeFHs7WvGtif"
    edits: str = "QRkn8QWyKjo1sKmpVKsoUJ"

    # types
    schema_type: str = "VdTsW1mGiy1XSooJaBBLc4"
    attribute_type: str = "GscJ2GELQjmLoaVrYyR3xm"
    relation_schema_type: str = "AKDxovGvZaPSWnmKnSoZJY"
    space_type: str = "7gzF671tq5JTZ13naG4tnr"
    account_type: str = "S7rX6suDMmU75yjbAD5WsP"
    proposal_type: str = "9No6qfEutiKg1WLeXDv73x"
    add_member_proposal: str = "6dJ23LRTHRdwqoWhtivRrM"
    remove_member_proposal: str = "8dJ23LRTHRdwqoWhtivRrM"
    add_editor_proposal: str = "7W7SE2UTj5YTsQvqSmCfLN"
    remove_editor_proposal: str = "9W7SE2UTj5YTsQvqSmCfLN"
    add_subspace_proposal: str = "DcEZrRpmAuwxfw7C5G7gjC"
    remove_subspace_proposal: str = "FcEZrRpmAuwxfw7C5G7gjC"
    edit_proposal: str = "GcEZrRpmAuwxfw7C5G7gjC"
    edit_type: str = "Q2dfub76oMdzJpyR8z4GZv"

    # value types
    text: str = "LckSTmjBrYAJaFcDs89am5"
    number: str = "LBdMpTNyycNffsF51t2eSp"
    checkbox: str = "G9NpD4c7GB7nH5YU9Tesgf"
    url: str = "5xroh3gbWYbWY4oR3nFXzy"
    time: str = "3mswMrL91GuYTfBq29EuNE"
    point: str = "UZBZNbA7Uhx1f8ebLi1Qj5"

    # spaces and networks
    indexer_space: str = "Y7z7eeWdupgZayxG9Lvi2Z"
    root_space: str = "25omwWh6HYgeRQKCaSpVpa"
    home_network: str = "KJjKetFsGVSbw9qFpRzRSy"

    @property
    def indexed(self) -> tuple[str, ...]:
        """Attributes whose values are embedded when they are written."""
        return (self.name, self.description)

    @property
    def inherited_down(self) -> tuple[str, ...]:
        """Attributes that always inherit from the parent spaces."""
        return (
            self.aggregation_direction,
            self.name,
            self.description,
            self.properties,
            self.relation_value_type,
            self.value_type,
        )


DEFAULT = Vocabulary()

# Codes and enumerations of the data model.
VALUE_TYPES = ("TEXT", "NUMBER", "CHECKBOX", "URL", "TIME", "POINT")
SET_TRIPLE = "SET_TRIPLE"
DELETE_TRIPLE = "DELETE_TRIPLE"
CREATE_RELATION = "CREATE_RELATION"
DELETE_RELATION = "DELETE_RELATION"
OP_PHASES = {SET_TRIPLE: 1, DELETE_TRIPLE: 2, CREATE_RELATION: 3, DELETE_RELATION: 4}
ADD_EDIT = "ADD_EDIT"
IMPORT_SPACE = "IMPORT_SPACE"
VOTE_OPTIONS = {2: "ACCEPT", 3: "REJECT"}
PROPOSAL_STATUSES = ("Proposed", "Accepted", "Rejected", "Canceled", "Executed")
GOVERNANCE_TYPES = ("Public", "Personal")
DIRECTIONS = ("Up", "Down", "Bidirectional")
UNVERSIONED = "0"
MAX_PAGE = 1000
SIMILARITY_THRESHOLD = 0.75
MAX_HOPS = 10
