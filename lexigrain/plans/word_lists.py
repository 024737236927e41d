"""Word lists of the languages, whole: directives, variables, properties, keywords and types."""

# Fixed values.
NGINX_DIRECTIVES = """
    accept_mutex accept_mutex_delay access_log add_after_body add_before_body add_header addition_types aio alias
    allow ancient_browser ancient_browser_value auth_basic auth_basic_user_file auth_http auth_http_header
    auth_http_pass_client_cert auth_http_timeout auth_request auth_request_set autoindex autoindex_exact_size
    autoindex_format autoindex_localtime break charset charset_map charset_types chunked_transfer_encoding
    client_body_buffer_size client_body_in_file_only client_body_in_single_buffer client_body_temp_path
    client_body_timeout client_header_buffer_size client_header_timeout client_max_body_size connection_pool_size
    create_full_put_path daemon dav_access dav_methods debug_connection debug_points default_type deny directio
    directio_alignment disable_symlinks empty_gif env error_log error_page etag events expires f4f f4f_buffer_size
    fastcgi_bind fastcgi_buffering fastcgi_buffers fastcgi_buffer_size fastcgi_busy_buffers_size fastcgi_cache
    fastcgi_cache_bypass fastcgi_cache_key fastcgi_cache_lock fastcgi_cache_lock_age fastcgi_cache_lock_timeout
    fastcgi_cache_methods fastcgi_cache_min_uses fastcgi_cache_path fastcgi_cache_purge fastcgi_cache_revalidate
    fastcgi_cache_use_stale fastcgi_cache_valid fastcgi_catch_stderr fastcgi_connect_timeout fastcgi_force_ranges
    fastcgi_hide_header fastcgi_ignore_client_abort fastcgi_ignore_headers fastcgi_index fastcgi_intercept_errors
    fastcgi_keep_conn fastcgi_limit_rate fastcgi_max_temp_file_size fastcgi_next_upstream
    fastcgi_next_upstream_timeout fastcgi_next_upstream_tries fastcgi_no_cache fastcgi_param fastcgi_pass
    fastcgi_pass_header fastcgi_pass_request_body fastcgi_pass_request_headers fastcgi_read_timeout
    fastcgi_request_buffering fastcgi_send_lowat fastcgi_send_timeout fastcgi_split_path_info fastcgi_store
    fastcgi_store_access fastcgi_temp_file_write_size fastcgi_temp_path flv geo geoip_city geoip_country geoip_org
    geoip_proxy geoip_proxy_recursive gunzip gunzip_buffers gzip gzip_buffers gzip_comp_level gzip_disable
    gzip_http_version gzip_min_length gzip_proxied gzip_static gzip_types gzip_vary hash health_check
    health_check_timeout hls hls_buffers hls_forward_args hls_fragment hls_mp4_buffer_size hls_mp4_max_buffer_size
    http http2_chunk_size http2_idle_timeout http2_max_concurrent_streams http2_max_field_size http2_max_header_size
    http2_recv_buffer_size http2_recv_timeout if if_modified_since ignore_invalid_headers image_filter
    image_filter_buffer image_filter_interlace image_filter_jpeg_quality image_filter_sharpen
    image_filter_transparency imap_auth imap_capabilities imap_client_buffer include index internal ip_hash keepalive
    keepalive_disable keepalive_requests keepalive_timeout large_client_header_buffers least_conn least_time
    limit_conn limit_conn_log_level limit_conn_status limit_conn_zone limit_except limit_rate limit_rate_after
    limit_req limit_req_log_level limit_req_status limit_req_zone limit_zone lingering_close lingering_time
    lingering_timeout listen location lock_file log_format log_not_found log_subrequest mail map map_hash_bucket_size
    map_hash_max_size master_process match max_ranges memcached_bind memcached_buffer_size memcached_connect_timeout
    memcached_force_ranges memcached_gzip_flag memcached_next_upstream memcached_next_upstream_timeout
    memcached_next_upstream_tries memcached_pass memcached_read_timeout memcached_send_timeout merge_slashes
    min_delete_depth modern_browser modern_browser_value mp4 mp4_buffer_size mp4_limit_rate mp4_limit_rate_after
    mp4_max_buffer_size msie_padding msie_refresh multi_accept ntlm open_file_cache open_file_cache_errors
    open_file_cache_min_uses open_file_cache_valid open_log_file_cache output_buffers override_charset pcre_jit perl
    perl_modules perl_require perl_set pid pop3_auth pop3_capabilities port_in_redirect postpone_output protocol
    proxy_bind proxy_buffer proxy_buffering proxy_buffers proxy_buffer_size proxy_busy_buffers_size proxy_cache
    proxy_cache_bypass proxy_cache_convert_head proxy_cache_key proxy_cache_lock proxy_cache_lock_age
    proxy_cache_lock_timeout proxy_cache_methods proxy_cache_min_uses proxy_cache_path proxy_cache_purge
    proxy_cache_revalidate proxy_cache_use_stale proxy_cache_valid proxy_connect_timeout proxy_cookie_domain
    proxy_cookie_path proxy_download_rate proxy_force_ranges proxy_headers_hash_bucket_size
    proxy_headers_hash_max_size proxy_hide_header proxy_http_version proxy_ignore_client_abort proxy_ignore_headers
    proxy_intercept_errors proxy_limit_rate proxy_max_temp_file_size proxy_method proxy_next_upstream
    proxy_next_upstream_timeout proxy_next_upstream_tries proxy_no_cache proxy_pass proxy_pass_error_message
    proxy_pass_header proxy_pass_request_body proxy_pass_request_headers proxy_protocol proxy_read_timeout
    proxy_redirect proxy_request_buffering proxy_send_lowat proxy_send_timeout proxy_set_body proxy_set_header
    proxy_ssl proxy_ssl_certificate proxy_ssl_certificate_key proxy_ssl_ciphers proxy_ssl_crl proxy_ssl_name
    proxy_ssl_password_file proxy_ssl_protocols proxy_ssl_server_name proxy_ssl_session_reuse
    proxy_ssl_trusted_certificate proxy_ssl_verify proxy_ssl_verify_depth proxy_store proxy_store_access
    proxy_temp_file_write_size proxy_temp_path proxy_timeout proxy_upload_rate queue random_index read_ahead
    real_ip_header real_ip_recursive recursive_error_pages referer_hash_bucket_size referer_hash_max_size
    request_pool_size reset_timedout_connection resolver resolver_timeout return rewrite rewrite_log root satisfy
    scgi_bind scgi_buffering scgi_buffers scgi_buffer_size scgi_busy_buffers_size scgi_cache scgi_cache_bypass
    scgi_cache_key scgi_cache_lock scgi_cache_lock_age scgi_cache_lock_timeout scgi_cache_methods scgi_cache_min_uses
    scgi_cache_path scgi_cache_purge scgi_cache_revalidate scgi_cache_use_stale scgi_cache_valid scgi_connect_timeout
    scgi_force_ranges scgi_hide_header scgi_ignore_client_abort scgi_ignore_headers scgi_intercept_errors
    scgi_limit_rate scgi_max_temp_file_size scgi_next_upstream scgi_next_upstream_timeout scgi_next_upstream_tries
    scgi_no_cache scgi_param scgi_pass scgi_pass_header scgi_pass_request_body scgi_pass_request_headers
    scgi_read_timeout scgi_request_buffering scgi_send_timeout scgi_store scgi_store_access scgi_temp_file_write_size
    scgi_temp_path secure_link secure_link_md5 secure_link_secret sendfile sendfile_max_chunk send_lowat send_timeout
    server server_name server_name_in_redirect server_names_hash_bucket_size server_names_hash_max_size server_tokens
    session_log session_log_format session_log_zone set set_real_ip_from slice smtp_auth smtp_capabilities
    source_charset spdy_chunk_size spdy_headers_comp split_clients ssi ssi_last_modified ssi_min_file_chunk
    ssi_silent_errors ssi_types ssi_value_length ssl ssl_buffer_size ssl_certificate ssl_certificate_key ssl_ciphers
    ssl_client_certificate ssl_crl ssl_dhparam ssl_ecdh_curve ssl_engine ssl_handshake_timeout ssl_password_file
    ssl_prefer_server_ciphers ssl_protocols ssl_session_cache ssl_session_ticket_key ssl_session_tickets
    ssl_session_timeout ssl_stapling ssl_stapling_file ssl_stapling_responder ssl_stapling_verify
    ssl_trusted_certificate ssl_verify_client ssl_verify_depth starttls state status status_format status_zone sticky
    sticky_cookie_insert stream stub_status sub_filter sub_filter_last_modified sub_filter_once sub_filter_types
    tcp_nodelay tcp_nopush thread_pool timeout timer_resolution try_files types types_hash_bucket_size
    types_hash_max_size underscores_in_headers uninitialized_variable_warn upstream upstream_conf use user userid
    userid_domain userid_expires userid_mark userid_name userid_p3p userid_path userid_service uwsgi_bind
    uwsgi_buffering uwsgi_buffers uwsgi_buffer_size uwsgi_busy_buffers_size uwsgi_cache uwsgi_cache_bypass
    uwsgi_cache_key uwsgi_cache_lock uwsgi_cache_lock_age uwsgi_cache_lock_timeout uwsgi_cache_methods
    uwsgi_cache_min_uses uwsgi_cache_path uwsgi_cache_purge uwsgi_cache_revalidate uwsgi_cache_use_stale
    uwsgi_cache_valid uwsgi_connect_timeout uwsgi_force_ranges uwsgi_hide_header uwsgi_ignore_client_abort
    uwsgi_ignore_headers uwsgi_intercept_errors uwsgi_limit_rate uwsgi_max_temp_file_size uwsgi_modifier1
    uwsgi_modifier2 uwsgi_next_upstream uwsgi_next_upstream_timeout uwsgi_next_upstream_tries uwsgi_no_cache
    uwsgi_param uwsgi_pass uwsgi_pass_header uwsgi_pass_request_body uwsgi_pass_request_headers uwsgi_read_timeout
    uwsgi_request_buffering uwsgi_send_timeout uwsgi_ssl_certificate uwsgi_ssl_certificate_key uwsgi_ssl_ciphers
    uwsgi_ssl_crl uwsgi_ssl_name uwsgi_ssl_password_file uwsgi_ssl_protocols uwsgi_ssl_server_name
    uwsgi_ssl_session_reuse uwsgi_ssl_trusted_certificate uwsgi_ssl_verify uwsgi_ssl_verify_depth uwsgi_store
    uwsgi_store_access uwsgi_temp_file_write_size uwsgi_temp_path valid_referers variables_hash_bucket_size
    variables_hash_max_size worker_aio_requests worker_connections worker_cpu_affinity worker_priority
    worker_processes worker_rlimit_core worker_rlimit_nofile working_directory xclient xml_entities xslt_last_modified
    xslt_param xslt_string_param xslt_stylesheet xslt_types zone
"""

# Fixed values.
NGINX_VARIABLES = """
    $ancient_browser $args $binary_remote_addr $body_bytes_sent $bytes_sent $connection $connection_requests
    $connections_active $connections_reading $connections_waiting $connections_writing $content_length $content_type
    $date_gmt $date_local $document_root $document_uri $fastcgi_path_info $fastcgi_script_name $geoip_area_code
    $geoip_city $geoip_city_continent_code $geoip_city_country_code $geoip_city_country_code3 $geoip_city_country_name
    $geoip_country_code $geoip_country_code3 $geoip_country_name $geoip_dma_code $geoip_latitude $geoip_longitude
    $geoip_org $geoip_postal_code $geoip_region $geoip_region_name $gzip_ratio $host $hostname $http2 $https
    $invalid_referer $is_args $limit_rate $memcached_key $modern_browser $msec $msie $nginx_version $pid $pipe
    $proxy_add_x_forwarded_for $proxy_host $proxy_port $proxy_protocol_addr $query_string $realip_remote_addr
    $realpath_root $remote_addr $remote_port $remote_user $request $request_body $request_body_file
    $request_completion $request_filename $request_length $request_method $request_time $request_uri $scheme
    $secure_link $secure_link_expires $server_addr $server_name $server_port $server_protocol $session_log_binary_id
    $session_log_id $slice_range $spdy $spdy_request_priority $ssl_cipher $ssl_client_cert $ssl_client_fingerprint
    $ssl_client_i_dn $ssl_client_raw_cert $ssl_client_s_dn $ssl_client_serial $ssl_client_verify $ssl_protocol
    $ssl_server_name $ssl_session_id $ssl_session_reused $status $tcpinfo_rcv_space $tcpinfo_rtt $tcpinfo_rttvar
    $tcpinfo_snd_cwnd $time_iso8601 $time_local $uid_got $uid_reset $uid_set $upstream_addr $upstream_cache_status
    $upstream_connect_time $upstream_header_time $upstream_response_length $upstream_response_time $upstream_status
    $uri
"""

# Fixed values.
NGINX_PREFIXES = """
    $arg_ $cookie_ $http_ $sent_http_ $upstream_cookie_ $upstream_http_
"""

# Fixed values.
CSS_PROPERTIES = """
    align-content align-items align-self alignment-adjust alignment-baseline all anchor-point animation
    animation-delay animation-direction animation-duration animation-fill-mode animation-iteration-count
    animation-name animation-play-state animation-timing-function appearance azimuth backface-visibility background
    background-attachment background-clip background-color background-image background-origin background-position
    background-repeat background-size baseline-shift binding bleed bookmark-label bookmark-level bookmark-state
    bookmark-target border border-bottom border-bottom-color border-bottom-left-radius border-bottom-right-radius
    border-bottom-style border-bottom-width border-collapse border-color border-image border-image-outset
    border-image-repeat border-image-slice border-image-source border-image-width border-left border-left-color
    border-left-style border-left-width border-radius border-right border-right-color border-right-style
    border-right-width border-spacing border-style border-top border-top-color border-top-left-radius
    border-top-right-radius border-top-style border-top-width border-width bottom box-align box-decoration-break
    box-direction box-flex box-flex-group box-lines box-ordinal-group box-orient box-pack box-shadow box-sizing
    break-after break-before break-inside caption-side clear clip clip-path clip-rule color color-profile column-count
    column-fill column-gap column-rule column-rule-color column-rule-style column-rule-width column-span column-width
    columns content counter-increment counter-reset crop cue cue-after cue-before cursor direction display
    dominant-baseline drop-initial-after-adjust drop-initial-after-align drop-initial-before-adjust
    drop-initial-before-align drop-initial-size drop-initial-value elevation empty-cells filter fit fit-position flex
    flex-basis flex-direction flex-flow flex-grow flex-shrink flex-wrap float float-offset font font-family
    font-feature-settings font-kerning font-language-override font-size font-size-adjust font-stretch font-style
    font-synthesis font-variant font-variant-alternates font-variant-caps font-variant-east-asian
    font-variant-ligatures font-variant-numeric font-variant-position font-weight grid-cell grid-column
    grid-column-align grid-column-sizing grid-column-span grid-columns grid-flow grid-row grid-row-align
    grid-row-sizing grid-row-span grid-rows grid-template hanging-punctuation height hyphenate-after hyphenate-before
    hyphenate-character hyphenate-lines hyphenate-resource hyphens icon image-orientation image-rendering
    image-resolution ime-mode inline-box-align justify-content left letter-spacing line-break line-height
    line-stacking line-stacking-ruby line-stacking-shift line-stacking-strategy list-style list-style-image
    list-style-position list-style-type margin margin-bottom margin-left margin-right margin-top mark mark-after
    mark-before marker-offset marks marquee-direction marquee-loop marquee-play-count marquee-speed marquee-style mask
    max-height max-width min-height min-width move-to nav-down nav-index nav-left nav-right nav-up object-fit
    object-position opacity order orphans outline outline-color outline-offset outline-style outline-width overflow
    overflow-style overflow-wrap overflow-x overflow-y padding padding-bottom padding-left padding-right padding-top
    page page-break-after page-break-before page-break-inside page-policy pause pause-after pause-before perspective
    perspective-origin phonemes pitch pitch-range play-during pointer-events position presentation-level
    punctuation-trim quotes rendering-intent resize rest rest-after rest-before richness right rotation rotation-point
    ruby-align ruby-overhang ruby-position ruby-span size speak speak-as speak-header speak-numeral speak-punctuation
    speech-rate src stress string-set tab-size table-layout target target-name target-new target-position text-align
    text-align-last text-combine-horizontal text-decoration text-decoration-color text-decoration-line
    text-decoration-skip text-decoration-style text-emphasis text-emphasis-color text-emphasis-position
    text-emphasis-style text-height text-indent text-justify text-orientation text-outline text-overflow
    text-rendering text-shadow text-space-collapse text-transform text-underline-position text-wrap top transform
    transform-origin transform-style transition transition-delay transition-duration transition-property
    transition-timing-function unicode-bidi vertical-align visibility voice-balance voice-duration voice-family
    voice-pitch voice-pitch-range voice-range voice-rate voice-stress voice-volume volume white-space widows width
    word-break word-spacing word-wrap writing-mode z-index
"""

# Fixed values.
CSS_VALUES = """
    above absolute always armenian aural auto avoid baseline behind below bidi-override blink block bold bolder both
    bottom capitalize center center-left center-right circle cjk-ideographic close-quote collapse condensed continuous
    crop cross crosshair cursive dashed decimal decimal-leading-zero default digits disc dotted double e-resize embed
    expanded extra-condensed extra-expanded fantasy far-left far-right fast faster fixed georgian groove hebrew help
    hidden hide high higher hiragana hiragana-iroha icon inherit inline inline-table inset inside invert italic
    justify katakana katakana-iroha landscape large larger left left-side leftwards level lighter line-through
    list-item loud low lower lower-alpha lower-greek lower-roman lowercase ltr medium message-box middle mix monospace
    n-resize narrower ne-resize no-close-quote no-open-quote no-repeat none normal nowrap nw-resize oblique once
    open-quote outset outside overline pointer portrait px relative repeat repeat-x repeat-y rgb ridge right
    right-side rightwards s-resize sans-serif scroll se-resize semi-condensed semi-expanded separate serif show silent
    slow slower small-caps small-caption smaller soft solid spell-out square static status-bar super sw-resize
    table-caption table-cell table-column table-column-group table-footer-group table-header-group table-row
    table-row-group text text-bottom text-top thick thin top transparent ultra-condensed ultra-expanded underline
    upper-alpha upper-latin upper-roman uppercase url visible w-resize wait wider x-fast x-high x-large x-loud x-low
    x-small x-soft xx-large xx-small yes
"""

# Fixed values.
CSS_PREFIXES = """
    -ah- -atsc- -hp- -khtml- -moz- -ms- -o- -rim- -ro- -tc- -wap- -webkit- -xv- mso- prince-
"""

# Fixed values.
POSTGRESQL_KEYWORDS = """
    abort absolute access action add admin after aggregate all also alter always analyse analyze and any array as asc
    assertion assignment asymmetric at attribute authorization backward before begin between binary both by cache
    called cascade cascaded case cast catalog chain char characteristics check checkpoint class close cluster coalesce
    collate collation column comment comments commit committed concurrently configuration connection constraint
    constraints content continue conversion copy cost create cross csv current current_catalog current_date
    current_role current_schema current_time current_timestamp current_user cursor cycle data database day deallocate
    dec declare default defaults deferrable deferred definer delete delimiter delimiters desc dictionary disable
    discard distinct do document domain double drop each else enable encoding encrypted end enum escape event except
    exclude excluding exclusive execute exists explain extension external extract false family fetch filter first
    following for force foreign forward freeze from full function functions global grant granted greatest group
    handler having header hold hour identity if ilike immediate immutable implicit import in including increment index
    indexes inherit inherits initially inline inner inout input insensitive insert instead intersect into invoker is
    isnull isolation join key label language large last lateral leading leakproof least left level like limit listen
    load local localtime localtimestamp location lock locked logged mapping match materialized maxvalue minute
    minvalue mode month move name names national natural nchar next no none not nothing notify notnull nowait null
    nullif nulls object of off offset oids on only operator option options or order ordinality out outer over overlaps
    overlay owned owner parser partial partition passing password placing plans policy position preceding precision
    prepare prepared preserve primary prior privileges procedural procedure program quote range read reassign recheck
    recursive ref references refresh reindex relative release rename repeatable replace replica reset restart restrict
    returning returns revoke right role rollback row rows rule savepoint schema scroll search second security select
    sequence sequences serializable server session session_user set setof share show similar simple skip snapshot some
    stable standalone start statement statistics stdin stdout storage strict strip substring symmetric sysid system
    table tables tablespace temp template temporary then to trailing transaction treat trigger trim true truncate
    trusted type types unbounded uncommitted unencrypted union unique unknown unlisten unlogged until update user
    using vacuum valid validate validator value values variadic varying verbose version view views volatile when where
    whitespace window with within without work wrapper write xmlattributes xmlconcat xmlelement xmlexists xmlforest
    xmlparse xmlpi xmlroot xmlserialize year yes zone
"""

# Fixed values.
POSTGRESQL_TYPES = """
    anyarray bigint bigserial bit bool boolean box bytea character cidr circle citext date decimal float float4 float8
    inet int int2 int4 int8 integer interval json jsonb line lseg macaddr money numeric path pg_lsn point polygon real
    serial serial2 serial4 serial8 smallint smallserial text time timestamp tsquery tsvector txid_snapshot uuid varbit
    varchar xml
"""

# Fixed values.
MYSQL_KEYWORDS = """
    accessible add all alter analyze as asc asensitive before between bigint binary blob both by call cascade case
    change char check collate column condition constraint continue convert create cross curdate current_user cursor
    curtime database databases day_hour day_microsecond day_minute day_second decimal declare default delayed delete
    desc describe deterministic distinct double drop dual each else elseif enclosed escaped exists exit fetch float
    for force foreign from fulltext get grant group having high_priority hour_microsecond hour_minute hour_second if
    ignore in index infile inner inout insensitive insert int interval into io_after_gtids io_before_gtids iterate
    join key keys kill leading leave left limit linear lines load lock long longblob longtext loop low_priority
    master_bind master_ssl_verify_server_cert match max_value mediumblob mediumint mediumtext minute_microsecond
    minute_second modifies natural now no_write_to_binlog numeric on optimize option optionally order out outer
    outfile partition precision primary procedure purge range read reads read_write real references release rename
    repeat replace require resignal restrict return revoke right second_microsecond select sensitive separator set
    show signal smallint spatial specific sql sqlexception sqlstate sqlwarning sql_big_result sql_calc_found_rows
    sql_small_result ssl starting straight_join table terminated then tinyblob tinyint tinytext to trailing trigger
    undo union unique unlock unsigned update usage use using utc_date utc_time utc_timestamp values varbinary varchar
    varying when where while with write year_month zerofill
"""

# Fixed values.
MYSQL_OPERATORS = """
    and div is like mod not or regexp rlike xor
"""

# Fixed values.
MYSQL_CONSTANTS = """
    false null true
"""
